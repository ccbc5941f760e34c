import os

import pytest

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as n_lines", "'x' as score")
    extra = spark.createDataFrame([(10**6, None, None, "s", None, 1, "x"), (10**6 + 1, "", "en", None, 0, 1, "x"), (10**6 + 2, "99 !!", "en", "s", 5, 1, "x")], docs.schema)
    now = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, now, SF), name)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in now.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        now = out
    kept = {r.doc_id: r for r in now.collect()}
    assert not {10**6, 10**6 + 1, 10**6 + 2} & set(kept)
    assert all(r.n_lines == 1 and r.score == "x" for r in kept.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {p.doc_id for p in pieces} == set(kept)


def test_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    now = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def slow_lines(texts):
    """Lines of ten documents or more only where they come first; documents that lose all their words go."""
    strip = lambda x: x.strip(" \t\n\x0b\f\r")
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(x))
    docs, first = {}, {}
    for i in sorted(texts):
        for p, x in enumerate(texts[i].split("\n")):
            if k := key(x):
                docs.setdefault(k, set()).add(i)
                first.setdefault(k, (i, p))
    out = {}
    for i, t in texts.items():
        kept = [x for p, x in enumerate(t.split("\n")) if not (k := key(x)) or len(docs[k]) < 10 or first[k] == (i, p)]
        if len(kept) == len(t.split("\n")) or any(strip(x) for x in kept):
            out[i] = "\n".join(kept)
    return out


def slow_copies(texts):
    """The smallest id of every group linked by sets of five words that are alike to 0.8."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_and_copies_equal_a_slow_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared = [(5000 + i, "A line of many documents \nown words %d one two three four five six seven eight nine ten" % (i // 2), "en", "s", 0) for i in range(24)]
    now = docs.unionByName(spark.createDataFrame(shared, docs.schema))
    texts = {r.doc_id: r.text or "" for r in now.collect()}
    want = slow_lines(texts)
    lines = corpus_pipeline.materialize(corpus_pipeline.drop_repeated_lines(spark, now, SF), "lines")
    got = {r.doc_id: r.text or "" for r in lines.collect()}
    assert got == want
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, lines, SF).collect()} == slow_copies(want)


def test_stages_bound_the_rows_of_an_arrow_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for given, then in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            for _, stage in corpus_pipeline.STAGES[:2] if given == "10000" else corpus_pipeline.STAGES[:1]:
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
                stage(spark, docs, SF)
                assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == then
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
