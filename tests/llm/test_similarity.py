import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _words, jaccard, vectors
from tessera.llm.components import components


def union(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k != 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, num):
    r = random.Random(n)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of"] * 100
    base = [[r.choice(vocab) for _ in range(120)] for _ in range(12)]
    rows = []
    for k in range(260):  # near copies with few to many edits, one large group among them
        w = list(base[0 if k % 3 == 0 else k % 12])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one"), (906, "a b c"), (907, "A  b\tc")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(6)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_documents(df, n=n, num=num).collect()}
    sets = sets_of(rows, n)
    ids = list(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * (i := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - i)]
    want = union(ids, links)
    assert got == {i: (len(sets[i]), want[i]) for i in ids}


def test_jaccard_of_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c d")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.component_id or 0) for x in jaccard.similar_documents(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert jaccard.similar_documents(df.limit(0)).count() == 0


def test_jaccard_of_one_id_with_several_texts_ties_them(spark):
    rows = [(1, "a b c d e"), (2, "p q r s t"), (3, "A b c d e"), (3, "p q r s t"), (4, "u v w"), (1, "a b c d e")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, k int, row string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similar_documents(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_jaccard_of_very_long_texts_and_very_long_words(spark):
    words = [f"w{i % 5000}x{i // 7}" for i in range(300_000)]
    other = list(words)
    for i in range(0, 300_000, 6000):
        other[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "y" * 1_000_000), (4, "Y" * 1_000_000), (5, "y" * 999_999)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][1] for i in range(1, 6)] == [1, 1, 3, 3, 5] and got[1][0] == 299_998 and got[3][0] == 1


@pytest.mark.parametrize("piece", [16, 64, 1 << 17])
def test_word_hashes_split_as_bytes_do(monkeypatch, piece):
    monkeypatch.setattr(_words, "PIECE", piece)
    r = random.Random(piece)
    for _ in range(60):
        texts = [None if r.random() < 0.05 else "".join(r.choice(["a", "B", "é", " ", "\n", "\t", "xyz", "ABCDEFGHIJ" * r.choice([1, 9]), "q" * r.choice([1, 70])]) for _ in range(r.choice([0, 1, 30]))) for _ in range(r.choice([0, 1, 12]))]
        hashes, counts = _words.word_hashes(pa.array(texts, pa.string()))
        split = [(t or "").encode().lower().split() for t in texts]
        assert counts.tolist() == [len(x) for x in split]
        met = dict(zip((w for x in split for w in x), hashes.tolist()))
        assert [met[w] for x in split for w in x] == hashes.tolist() and len(set(met.values())) == len(met)


def test_signatures_never_deny_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = r.integers(0, 1 << 62, r.integers(1, 400)).astype(np.uint64)
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.uniform(0.6, 1)], r.integers(0, 1 << 62, r.integers(0, 30)).astype(np.uint64)]))
        a = np.unique(a)
        bits = sum(int(x ^ y).bit_count() for x, y in zip(jaccard.signature(a).view(np.uint64), jaccard.signature(b).view(np.uint64)))
        assert bits <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


@pytest.mark.parametrize("block", [1000, 40])
def test_vectors_equal_brute_force(spark, block):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 24))
    x = [c + r.normal(size=24) * r.uniform(0, 0.25) for c in centres for _ in range(6)] + [centres[0] + r.normal(size=24) * 0.1 for _ in range(150)]
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)]
    rows += [(500 + i, rows[0][1]) for i in range(5)] + [(600, None), (601, [0.0] * 24), (602, [float("nan")] * 24), (603, [1.0, None]), (604, []), (605, [1e200] * 24), (606, [2e200] * 24)]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<double>, m string")
    got = {a.vec_id: (a.n_links, a.component_id, a.kept) for a in vectors.similar_vectors(df, block=block).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    comp = union([i for i, _ in rows], links)
    found = sum(v[0] for v in got.values()) / 2
    assert found >= 0.99 * len(links) and found <= len(links)
    assert got[600] == (0, 600, True) and got[605][1] == 605 and got[606][1] == 605
    assert sum(got[i][1] != comp[i] for i in comp) <= 2
    assert vectors.similar_vectors(df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    h = vectors.hadamard(np.eye(16))
    assert np.array_equal(h @ h.T, 16 * np.eye(16))


def test_planned_tables_find_the_planned_share_of_links():
    rng = np.random.default_rng(8)
    for n, dim, cosine in ((50_000, 1024, 0.9), (1_000_000, 8, 0.9), (3_000, 64, 0.7)):  # low dimension: five hashes, not all probes
        hashes, tables, probes = vectors.plan_of(n, dim, cosine)
        x = rng.standard_normal((1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal((1000, dim))
        z -= (z * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = (vectors.buckets_of(v, hashes, tables, probes) for v in (x, y))
        met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
        assert (~met).sum() <= 6, (dim, cosine, (~met).sum())
