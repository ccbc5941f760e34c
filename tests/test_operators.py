import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import answer, compile, governance, graph, ingest, lexical, lifecycle, quality, retrieval
from tessera.sources import tables

MD = """---
title: "ACME 2024年报"
acl: [finance-team, board]
ttl: 1d
valid_from: 2020-01-01
---
intro line
# 财务分析
## 负债分析
营收 32 亿元，负债 18 亿元。
second line

| a | b |
## 现金流
- 7.5 亿元
- x
"""


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_markdown(spark):
    sections, blocks = ingest.parse(spark.createDataFrame([("a.md", MD, "raw")], S.DOCUMENT))
    got = {r.id: r for r in blocks.collect()}
    assert set(got) == {"a.md/0", "a.md#财务分析/负债分析/0", "a.md#财务分析/负债分析/1", "a.md#财务分析/现金流/0"}
    b = got["a.md#财务分析/负债分析/0"]
    assert (b.raw, b.type, b.breadcrumb, len(b.hash)) == ("营收 32 亿元，负债 18 亿元。\nsecond line", "paragraph", "财务分析 > 负债分析", 16)
    assert got["a.md#财务分析/负债分析/1"].type == "table" and got["a.md#财务分析/现金流/0"].type == "list"
    s = {r.id: r for r in sections.collect()}
    assert s["a.md#财务分析/现金流"].parent_id == "a.md#财务分析" and s["a.md#财务分析"].parent_id is None and s["a.md#财务分析"].summary == ""
    fm = one(spark, MD, ingest.frontmatter_map)
    assert fm["title"] == ["ACME 2024年报"] and fm["acl"] == ["finance-team", "board"]


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".index").mkdir()
    (tmp_path / "sub" / "a b.md").write_text(MD)
    (tmp_path / "x.txt").write_text("no")
    (tmp_path / ".index" / "y.md").write_text("no")
    got = tables.documents(spark, str(tmp_path)).collect()
    assert [(r.path, r.title) for r in got] == [("sub/a b.md", "ACME 2024年报")]


def test_content_hash_slug_and_types(spark):
    h = lambda t: one(spark, t, X.content_hash)
    assert h("a   b\n\nc") == h("a b c") == h(" a b c ") and len(h("x")) == 16
    assert one(spark, "ACME Corp!", X.slug) == "acme-corp" and one(spark, "--", X.slug) == "entity"
    assert one(spark, "a [[x/y#z|q]] [[ w ]]", X.wikilinks) == ["x/y", "w"]
    assert one(spark, "./wiki\\a", X.page_key) == "a"


@pytest.mark.parametrize("claim,evidence,want", [("revenue was 32", "revenue 32", "entailed"), ("revenue was 32", "revenue 99", "contradicted"), ("no numerals", "revenue 99", "unknown")])
def test_judge(spark, claim, evidence, want):
    assert spark.range(1).select(X.judge(F.lit(claim), F.lit(evidence))).first()[0] == want


@pytest.mark.parametrize("text,n,want", [("One (d#1/0).", 1, []), ("One (d#1/0)；\nTwo", 1, ["citation 1/2 sentences cited"]), ("One", 0, ["citation 0/1 sentences cited", "refusal"]), (S.REFUSAL, 0, ["citation 0/1 sentences cited"])])
def test_contracts(spark, text, n, want):
    df = spark.createDataFrame([(text, n)], "answer string, n_evidence int")
    assert answer.check_contracts(df).first().violations == want


@pytest.mark.parametrize("state,stale,risk,want", [("active", False, False, "use"), ("active", True, False, "downrank_and_async_recompile"), ("active", True, True, "refuse_or_recompile"), ("retracted", True, False, "hard_filter"), ("superseded", False, False, "filtered_unless_explicit_history")])
def test_disposition(spark, state, stale, risk, want):
    assert spark.range(1).select(X.disposition(F.lit(state), F.lit(stale), F.lit(risk))).first()[0] == want


@pytest.mark.parametrize("acl,groups,want", [(None, None, True), (None, ["a"], True), (["a"], None, False), (["a"], ["a", "b"], True), (["a"], ["b"], False), ([], None, True)])
def test_acl_matrix(spark, acl, groups, want):
    df = spark.createDataFrame([(acl,)], "acl array<string>")
    assert df.filter(governance.allowed("acl", groups)).count() == int(want)


def test_rrf_and_full_corpus(spark):
    a, b = (spark.createDataFrame([(x, 0)], "id string, rank int") for x in "ab")
    assert {r.id: r.score for r in retrieval.rrf([(a, 1.0), (b, 1.0)]).collect()} == {"a": round(1 / 61, 9), "b": round(1 / 61, 9)}
    blocks = spark.createDataFrame([("a", "d", 0, "xxxx")], "id string, doc_path string, ordinal int, raw string")
    assert retrieval.full_corpus(blocks).count() == 1 and retrieval.full_corpus(blocks, 1).count() == 0


def test_bm25_formula_and_ladder(spark):
    rows = [(f"d{i}", "", t) for i, t in enumerate(["revenue up", "cost down", "revenue revenue", "营收 增长 强", "nothing", "other words here", "more"])]
    blocks = spark.createDataFrame(rows, "id string, breadcrumb string, raw string")
    got = {r.id: r.score for r in lexical.bm25(blocks, "revenue", 10).collect()}
    docs = {i: [i] + 2 * t.split() for i, _, t in rows if "营" not in t}
    sizes = {i: len(v) for i, v in docs.items()} | {"d3": 1 + 3 + 5}
    avg = sum(sizes.values()) / 7
    idf = math.log((7 - 2 + 0.5) / 2.5)
    for i in ("d0", "d2"):
        f = docs[i].count("revenue")
        assert abs(got[i] - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[i] / avg))) < 1e-5
    assert set(got) == {"d0", "d2"}
    assert [r.id for r in lexical.bm25(blocks, "营收", 10).collect()] == ["d3"]
    assert [(r.id, r.rung) for r in lexical.bm25(blocks, "营长", 10).collect()] == [("d3", 3)]
    assert lexical.bm25(blocks, "revenue nothing", 10).count() == 0  # two of the terms must stand in a row
    assert lexical.bm25(blocks, "??", 10).count() == 0


def test_pagerank_kernel_and_joins_agree(spark):
    links = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("b", "d", 1.0)]
    edges = spark.createDataFrame(links, "src string, dst string, w double")
    seeds = spark.createDataFrame([(0, "a")], "query int, id string")
    k = {r.id: r.pr for r in graph.personalized_pagerank(edges, seeds, 30, None).collect()}
    spark.sparkContext.setCheckpointDir("/tmp/spark-tests-checkpoint")
    j = {r.id: r.pr for r in graph.pagerank_by_joins(edges, seeds, 30).collect()}
    assert set(k) == set(j) == set("abcd") and all(abs(k[x] - j[x]) < 1e-9 for x in k) and abs(sum(k.values()) - 1) < 1e-9


def test_hidden_states_and_bands(spark):
    rows = spark.createDataFrame([(0, "x", "p"), (1, "y", "q"), (2, "z", "r")], "rank int, id string, doc_path string")
    states = spark.createDataFrame([("x", "superseded"), ("y", "retracted")], "id string, state string")
    seen = lambda inc: [r.id for r in governance.state_filter(rows, states, inc).orderBy("rank").collect()]
    assert seen(()) == ["z"] and seen(("superseded",)) == ["x", "z"]
    pages = spark.createDataFrame([("p", "active", True), ("q", "retracted", False)], "doc_path string, state string, stale boolean")
    assert [r.id for r in governance.disposition_bands(rows, pages).orderBy("rank").collect()] == ["z", "x"]


def test_ledger_round_trip_and_errors(spark):
    rows = spark.createDataFrame([("b1", "retracted", "wrong", "h1", "2024")], "id string, state string, reason string, content_hash string, updated string")
    back = tables.ledger(tables.ledger_text(rows))
    assert back.first().asDict() == rows.first().asDict()
    blocks = spark.createDataFrame([("b1", "h1"), ("b2", "h1")], "id string, hash string")
    assert lifecycle.replay_ledger(back, blocks).collect()[0].id == "b1"
    assert lifecycle.replay_ledger(back, blocks.withColumn("hash", F.lit("h2"))).count() == 0
    for bad in ('```json\n{"version": 2, "blocks": {}}\n```', '```json\n{"version": 1, "blocks": {"a": {"state": "odd"}}}\n```'):
        with pytest.raises(Exception):
            tables.ledger(spark.createDataFrame([(bad,)], "text string")).collect()


def test_retraction_marks_citing_pages(spark):
    pages = spark.createDataFrame([("p1", "so [[d#a/0]]"), ("p2", "none")], "page string, text string")
    assert [r.page for r in lifecycle.retract(spark.createDataFrame([("d#a/0",)], "id string"), pages).collect()] == ["p1"]


def test_lint(spark):
    links = spark.createDataFrame([("a", "raw/x.md#s"), ("b", "gone")], "src string, target string")
    assert [r.src for r in quality.broken_links(links, spark.createDataFrame([("x.md",)], "key string")).collect()] == ["b"]
    blocks = spark.createDataFrame([("w", "- one\n- two [[a#b]]\n* three", "wiki"), ("r", "- one", "raw")], "id string, raw string, layer string")
    assert sorted(r.line for r in quality.unsourced(blocks).collect()) == ["* three", "- one"]
    docs = spark.createDataFrame([("p", "1d", "2020-01-01"), ("q", "9999999", "2020-01-01"), ("s", None, None)], "path string, ttl string, valid_from string")
    assert [r.path for r in quality.expired(docs, F.lit("2024-01-01").cast("date")).collect()] == ["p"]


def test_grading_assembly_and_answer(spark):
    rows = spark.createDataFrame([(0, "d#a/0", "d", "A", "Revenue was 32"), (1, "d#a/1", "d", "A", "x" * 300)], "rank int, id string, doc_path string, breadcrumb string, raw string")
    verdict = lambda df, q: answer.grade_terms(df, q).first().verdict
    assert verdict(rows, "revenue") == "enough" and verdict(rows, "zebra") == "missing" and verdict(rows.limit(0), "x") == "evidence_absent"
    pieces = answer.assemble(rows, 200).orderBy("rank").collect()
    assert len(pieces) == 2 and sum(len(p.piece) for p in pieces) == 200
    assert len(answer.assemble(rows, 100).collect()) == 1
    assert answer.extractive_answer(rows.limit(0)).first().answer == S.REFUSAL
    assert "[[d#a/0]]" in answer.extractive_answer(rows).first().answer


def test_entities_and_summary(spark):
    blocks = spark.createDataFrame([("a", "d1", 0, "Acme Corp met NASA. 华夏银行"), ("b", "d2", 0, "ACME and Acme Corp")], "id string, doc_path string, ordinal int, raw string")
    got = {r.entity_id: r for r in compile.entities(compile.mentions(blocks)).collect()}
    assert got["acme-corp"].n_facts == 2 and {"nasa", "acme", "华夏银行"} <= set(got)
    assert one(spark, "x", lambda c: X.summary(F.array(F.lit("aaaa."), F.lit("bbbb."), F.lit("cccc.")), 11)) == "aaaa. bbbb."


def test_pages_of_scans(spark):
    pages = spark.createDataFrame([("p", 1, "Title\nline one\nline two"), ("p", 2, ""), ("p", 3, "only a line")], "path string, page int, text string")
    got = {r.id: r for r in ingest.pages_to_blocks(pages).collect()}
    assert got["p#p1/0"].raw == "line one line two" and got["p#p1/0"].title == "Title" and got["p#p3/0"].title == "" and len(got) == 2
    assert ingest.looks_scanned(pages).first().scanned


def test_paged_files(spark, tmp_path):
    for name, data in {"a.pdf": b"x" * 50 + b"|" + b"y" * 60, "b.pdf": b"|", "c.pdf": b"bad"}.items():
        (tmp_path / name).write_bytes(data)

    def extract(data):
        if data == b"bad":
            raise ValueError
        return data.decode().split("|")

    def vision(data, page):
        if page == 2:
            raise ValueError
        return "seen"

    got = {(r.path[-5:], r.page): (r.text, r.ocr) for r in tables.page_texts(spark, str(tmp_path), extract, vision).collect()}
    assert got["a.pdf", 1] == ("x" * 50, False) and got["b.pdf", 1] == ("seen", True) and got["b.pdf", 2] == ("", True) and got["c.pdf", 1] == ("seen", True)


def test_incremental_vectors(spark):
    blocks = spark.createDataFrame([("a", "A > B", "x", "h1"), ("b", "A", "yy", "h2")], "id string, breadcrumb string, raw string, hash string")
    old = spark.createDataFrame([("b", "h2"), ("c", "h3")], "id string, hash string")
    delta = lifecycle.vector_delta(blocks, old)
    assert {r.id: r.action for r in delta.collect()} == {"a": "encode", "c": "drop"}
    got = retrieval.encode(blocks, delta, lambda ts: [[3.0, 4.0] if t == "B\nx" else [1.0, 0.0] for t in ts], 2).collect()
    assert [(r.id, r.vector, r.hash) for r in got] == [("a", [0.6, 0.8], "h1")]
    meta = spark.createDataFrame([("model", "m"), ("dims", "2")], "key string, value string")
    assert retrieval.check_identity(meta, {"model": "m", "dims": "2"}).first().same
    with pytest.raises(Exception):
        retrieval.check_identity(meta, {"model": "other"}).collect()


def test_mindmap_bounds_groups_before_titles_are_collected(spark):
    rows = [(1, i, f"t{i % 97}") for i in range(3000)] + [(2, 5, "b"), (2, 5, "a"), (None, 0, "x")]
    found = compile.mindmap(spark.createDataFrame(rows, "parent_id long, ordinal long, title string"))
    assert [(x.parent, x.position, x.titles) for x in found.orderBy("position").collect()] == [(1, 1, [f"t{i}" for i in range(6)]), (2, 2, ["a", "b"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_escalation_takes_han_runs_and_ascii_terms_apart(spark):
    rows = spark.createDataFrame([(1, "acme reports"), (2, "一家公司"), (3, "公"), (4, "nothing")], "rank int, raw string")
    assert {r["rank"] for r in answer.escalate(rows, "ACME公司").collect()} == {1, 2}
    assert answer.escalate(rows, "公 é").count() == 0


def test_knn_of_many_queries_equals_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8))
    x = np.concatenate([x, x[:5]]) / np.linalg.norm(np.concatenate([x, x[:5]]), axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>").repartition(3)
    got = {(q, k): (i, c) for q, i, c, k in (tuple(t) for t in retrieval.knn_many(df, df.filter("id % 20 = 0"), 7, rows=16).select("query", "id", "cosine", "rank").collect())}
    for q in range(0, 65, 20):
        cosine = np.round(x @ x[q], 6)
        want = sorted(range(65), key=lambda i: (-cosine[i], i))[:7]
        assert [got[q, k][0] for k in range(7)] == want
    assert len(got) == 28 and retrieval.knn_many(df.limit(0), df, 3).count() == 0


def test_index_counts_overlapping_phrases_and_takes_an_empty_table(spark, tmp_path):
    rows = [("a", "x", "中中中 中"), ("b", "中中", "other"), ("c", "x", ""), ("d", "x", "naïve Naive")]
    b = spark.createDataFrame(rows, "id string, breadcrumb string, raw string")
    index = lexical.Index.build(b, f"file://{tmp_path}/i", buckets=3)
    for q in ("中中", "中中 other", "naive x", "x 中中中", "absent"):
        assert [tuple(r) for r in index.search(q, 9).orderBy("rank").collect()] == [tuple(r) for r in lexical.bm25(b, q, 9).orderBy("rank").collect()]
    none = lexical.Index.build(b.limit(0), f"file://{tmp_path}/none")
    assert none.search("x", 5).count() == 0
