import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tessera.llm import bpe, packing  # noqa: E402

VOCAB = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a" * 3000, "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "ΟΔΟΣ Σ", "S:x", "don't 'THE' 12½", "a\x1cb\x85c\u200bd", "🎉é中文"]


def library():
    return tokenizers.Tokenizer.from_file(VOCAB)


def encoded(texts):
    b = bpe.load(VOCAB)
    made, at, offsets = bpe.WordCache(b, bytes).look_up(texts)
    return [np.frombuffer(b"".join(made[k] for k in at[x:y]), b.kind).tolist() for x, y in zip(offsets, offsets[1:])]


def test_encoding_equals_the_library():
    r = random.Random(3)
    alphabet = "ab'sStTreVE ll d\t\n éÉßΣσς1²½٣中文İ_-!?<|endoftext|>🎉ǅS:\x1c\x85\xa0"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    ref = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts) == ref
    b = bpe.load(VOCAB)
    for ids in ref[:300]:
        assert b.decode(ids) == library().decode(ids, skip_special_tokens=False)


def test_segment_tree_merges_the_leftmost_lowest_rank():
    b = bpe.load(VOCAB)
    for w in ["aaaaaaa", "thetheth", "ininining"]:
        chars = [b.mid[x] for x in w.encode()[:-1]] + [b.end[w.encode()[-1]]]
        while True:
            ranks = b.rank(np.array(chars[:-1]), np.array(chars[1:]))
            i = int(np.argmin(ranks))
            if ranks[i] == bpe.NONE:
                break
            chars[i : i + 2] = [b.merged[ranks[i]]]
        assert np.frombuffer(b.encode_words([w])[0], b.kind).tolist() == [int(c) for c in chars]


def test_cache_starts_anew_beyond_its_limit():
    c = bpe.WordCache(bpe.load(VOCAB), bytes, limit=3)
    assert len(c.look_up(["a b c d e f"])[1]) == 6
    made, at, _ = c.look_up(["a b"])
    assert len(c.known) == 2 and len(at) == 2


def test_digests_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "The Heat", "z"), (3, "The Heat", "z"), (None, "the", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_digests(df, VOCAB).collect()
    assert len(got) == 5 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert len({r.ids_sha256 for r in got if r.doc_id == 3}) == 1
    assert bpe.encode_digests(df.limit(0), VOCAB).count() == 0


def test_hilbert_neighbours_are_adjacent():
    n = 16
    cells = np.array([(i, j) for i in range(n) for j in range(n)])
    key = packing.hilbert_key(cells, 4)
    assert sorted(key) == list(range(n * n))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    cube = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    path = cube[np.argsort(packing.hilbert_key(cube, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("size", [8, 64])
def test_packing_keeps_every_id_once_without_padding(spark, size):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "heat", "onder", "x"]) for _ in range(r.randint(0, 60))), i) for i in range(80)]
    rows += [(100, None, 0), (101, "the " * 700, 0)] + [(200 + i, "same text here", 0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    got = packing.pack(df, VOCAB, size=size).collect()
    t = library()
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x, _ in rows}
    by_doc, by_seq = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.ids == ids[p.doc_id][p.start : p.start + p.length].tobytes() and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(p.ids) >= 0
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        assert sum(p.length for p in ps) == len(ids[d]) and len({p.start for p in ps}) == len(ps)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        total = 0
        for p in ps:
            assert p.offset == total
            total += p.length
        assert total <= size and total & (total - 1) == 0
    assert packing.pack(df.limit(0), VOCAB).count() == 0
