import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import lines, tiff


def brute(rows, min_docs, keep):
    docs = defaultdict(set)
    first = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    order = sorted({(i is not None, i or 0, p, lines.line_key(x.encode())) for i, ls in split for p, x in enumerate(ls)})
    for has, i, p, k in order:
        docs[k].add((has, i))
        first.setdefault(k, (has, i, p))
    out = {}
    for i, ls in split:
        kept = [x for p, x in enumerate(ls) if not ((k := lines.line_key(x.encode())) and len(docs[k]) >= min_docs) or (keep == "first" and first[k] == (i is not None, i or 0, p))]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, keep, seed):
    r = random.Random(seed)
    pool = ["Hot line ", "  b", "", "é", "\tTab", "C c"] + [f"l{i}" for i in range(30)]
    weights = [30, 3, 3, 2, 2, 2] + [1] * 30
    rows = [(i, "\n".join(r.choices(pool, weights, k=r.randint(0, 8)))) for i in range(150)] + [(1000, None), (None, "hot line\nnull id")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_lines int, pos string").repartition(5)
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df, min_docs=4, keep=keep)).collect()
    want = brute(rows, 4, keep)
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.kept) for x in got} == want and len(got) == len(rows)


def test_line_dedup_of_copies_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a\nb")] * 3 + [(6, "a\nc"), (7, "a")], "doc_id long, text string")
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df, min_docs=3)).collect()
    assert sorted((x.doc_id, x.kept) for x in got) == [(5, "b")] * 3 + [(6, "c"), (7, "")]
    assert lines.keep_bitmaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("scheme", ["none", "lzw", "deflate", "packbits"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(scheme, predictor, order):
    r = np.random.default_rng(5)
    pages = [r.integers(0, 4, (37, 53), dtype=np.uint8) * 60, r.integers(0, 65536, (20, 31), dtype=np.uint16), np.repeat(r.integers(0, 255, (9, 5, 3), dtype=np.uint8), 4, axis=1), r.integers(0, 255, (130, 100), dtype=np.uint8)]
    for tile in (0, 16):
        data = tiff.write_tiff(pages, scheme, predictor, rows=10, tile=tile, order=order)
        back = list(tiff.read_pages(data))
        assert [p[0] for p in back] == list(range(len(pages)))
        for p, a in zip(back, pages):
            assert np.array_equal(p[7].reshape(a.shape), a)


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 5000, 70000])
def test_codecs(size):
    r = random.Random(size)
    for data in (bytes(r.randrange(256) for _ in range(size)), b"ab" * (size // 2), b"\0" * size):
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_tiff_tables(spark):
    rows = [(1, None), (2, ""), (3, "é" * 4000), (4, "x" * 576), (5, "x" * 576), (6, "long " * 60000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, media int")
    media = tiff.text_to_tiff(df, page_rows=16)
    got = {r.doc_id: r for r in tiff.payload_digests(tiff.tiff_pages(media)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert got[4].media_sha256 == got[5].media_sha256 and got[1].feature == got[2].feature
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None), (3, bytearray(b"II*\0\xff\0\0\0"))], "doc_id long, media binary")
    assert {r.doc_id: bool(r.error) for r in tiff.tiff_pages(bad).collect()} == {1: True, 3: True}
    assert tiff.tiff_pages(media.limit(0)).count() == 0
