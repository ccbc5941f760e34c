"""Repeated rows, nulls, empty and very long texts and clashing columns, for operators whose other tests have none."""

import random
from collections import Counter

import pytest

from tessera.llm import bpe, html, packing, registry, tiff, toxicity, vectors

LONG = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta", "ü", "中文", "x1"], k=60_000))
TEXTS = [(1, "one two"), (1, "one two"), (2, ""), (3, None), (None, "null id"), (4, LONG), (5, "one two")]
CLASH = "start string, length int, ids string, sequence_id int, score string, x_ string, row_ string, page int, media string, n_tokens int, id string, t string, k int"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("s", 1, "i", 2, "sc", "x", "r", 3, "m", 4, "id", "t", 5)
    return spark.createDataFrame([(*r, *extra) for r in TEXTS], "doc_id long, text string, " + CLASH).repartition(3)


def per_id(rows, *cols):
    return Counter((r.doc_id, *(r[c] for c in cols)) for r in rows)


def test_packing(docs):
    rows = packing.pack(docs, registry.vocabulary()).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    sizes = {i: {r.doc_tokens for r in rows if r.doc_id == i} for i in total}
    assert set(total) == {1, 2, 3, 4, 5, None} and total[1] == 2 * sizes[1].copy().pop() and total[2] == total[3] == 1
    assert total[4] == sizes[4].copy().pop() > 60_000 and total[5] == sizes[1].copy().pop()


def test_bpe_and_tiff(docs):
    rows = bpe.encode_digests(docs, registry.vocabulary()).collect()
    assert sum(per_id(rows, "n_tokens").values()) == 7 and len({r.ids_sha256 for r in rows if r.doc_id in (1, 5)}) == 1
    rows = tiff.payload_digests(tiff.tiff_pages(tiff.text_to_tiff(docs))).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in TEXTS)
    assert {r.n_bytes for r in rows if r.doc_id == 4} == {len(LONG.encode())} and len({r.feature for r in rows if r.doc_id in (1, 5)}) == 1


def test_an_unreadable_file_is_an_error(spark):
    bad = spark.createDataFrame([(1, bytearray(b"II*\0not a tiff"))], "doc_id long, media binary")
    with pytest.raises(Exception, match="can't be read"):
        tiff.payload_digests(tiff.tiff_pages(bad)).collect()


def test_toxicity(spark, docs):
    train = spark.createDataFrame([(100 + i, "vile slur here" if i % 2 else "kind words here") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(120)] + [(100, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    rows = toxicity.score_documents(docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 5)}) == 1 and len({r.score for r in rows if r.doc_id in (2, 3)}) == 1


def test_html(spark):
    page = "<html><body><article><p>Some text</p></article></body></html>"
    rows = [(1, "http://a.org/1", page), (1, "http://a.org/1", page), (2, None, None), (3, "x", ""), (None, "http://a.org/2", page), (4, "http://a.org/4", f"<article><p>{LONG}</p></article>")]
    df = spark.createDataFrame([(*r, "h", "p", 1) for r in rows], "page_id long, url string, html string, host string, paths string, n_chars int")
    got = html.extract(df, html.wrappers(df)).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert {r.text for r in got if r.page_id in (1, None)} == {"Some text"} and {r.n_chars for r in got if r.page_id in (2, 3)} == {0} and [r.n_chars for r in got if r.page_id == 4] == [len(LONG)]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 1.0]), (6, [])]
    df = spark.createDataFrame([(*r, 1, "k", "v") for r in rows], "vec_id long, embedding array<float>, n_links int, component_id string, vec string")
    got = vectors.similar_vectors(df).collect()
    assert Counter(r.vec_id for r in got) == Counter(r[0] for r in rows)
    assert {r.vec_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6} and vectors.similar_vectors(df.limit(0)).count() == 0
