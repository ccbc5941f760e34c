import pytest
from pyspark.sql import functions as F

from tessera.engine import KnowledgeBase
from tessera.operators import graph, lexical, lifecycle
from tessera.sources.registry import Registry, Superseded, file_stamp, stamp_of
from tessera.streaming import replacing


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_readers_keep_their_version_and_one_writer_wins(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/r")
    empty = r.snapshot()
    one = r.publish(empty, {"t": r.write(spark.range(3))})
    other = r.write(spark.range(5))
    with pytest.raises(Superseded):
        r.publish(empty, {"t": other})
    two = r.publish(one, {"t": other}, marks={"feed": "4"})
    assert (one.table("t").count(), two.table("t").count(), r.snapshot().table("t").count()) == (3, 5, 5)
    assert (r.versions(), r.snapshot().marks, r.snapshot(1).version, empty.version) == ([1, 2], {"feed": "4"}, 1, 0)
    assert r.forget(keep=1) == 1 and r.versions() == [2] and r.snapshot().table("t").count() == 5


def test_parts_are_read_on_their_own(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/r")
    s = r.publish(r.snapshot(), {"t": r.write(spark.range(10).withColumn("part", F.col("id") % 3), "part"), "none": r.write(spark.range(0).withColumn("part", F.col("id")), "part")})
    assert ids(s.table("t", ["1"])) == [1, 4, 7] and s.table("t", ["9"]).count() == 0 and s.table("none").count() == 0
    assert s.table("t").columns == ["id"]


def test_derived_tables_are_built_once_for_a_stamp(spark, tmp_path):
    r, built = Registry(spark, f"file://{tmp_path}/r"), []

    def build():
        built.append(1)
        return spark.range(2)

    assert [r.derived("g", s, build)[1] for s in ("a", "a", "b", "b", "a")] == [True, False, True, False, True] and len(built) == 3


def test_stamps_see_every_change_and_no_order(spark):
    cols = ("id", "raw")
    rows = [("a", "x"), ("b", None), ("c", "")]
    of = lambda data: stamp_of(t=(spark.createDataFrame(data, "id string, raw string"), cols))
    first = of(rows)
    assert of(rows[::-1]) == first
    for other in ([("a", "x"), ("b", ""), ("c", "")], rows[:2], rows + rows[:1], [("ax", ""), ("b", None), ("c", "")], []):
        assert of(other) != first
    df = spark.createDataFrame(rows, "id string, raw string")
    assert stamp_of(t=(df, cols), u=(df, cols)) != stamp_of(t=(df, cols)) != stamp_of(u=(df, cols))
    assert lifecycle.corpus_stamp(df, *cols).first().n == 3


def change(spark, rows):
    return spark.createDataFrame(rows, replacing.CHANGE)


def test_changes_replace_delete_and_come_late(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/r")
    one = replacing.merge(r, change(spark, [(1, "a\nb", "en", "s", 1, False), (2, "c", "en", "s", 1, None), (3, None, "en", "s", 1, False), (None, "x", "en", "s", 1, False), (4, "x", "en", "s", None, False)]), 0)
    assert ids(one.table("blocks"), "raw") == ["a", "b", "c"]
    assert {(x.doc_id, x.change) for x in one.table("changes").collect()} == {(1, "added"), (2, "added"), (3, "added")}
    two = replacing.merge(r, change(spark, [(1, "b\nd", "en", "s", 3, False), (1, "no", "en", "s", 2, False), (2, None, None, None, 2, True), (3, "", "en", "s", 2, False)]), 1)
    assert ids(two.table("blocks"), "raw") == ["b", "d"] and {(x.doc_id, x.change) for x in two.table("changes").collect()} == {(1, "changed"), (2, "deleted")}
    again = replacing.merge(r, change(spark, [(1, "zz", "en", "s", 9, False)]), 1)  # a batch that was applied
    assert again.version == two.version
    late = replacing.merge(r, change(spark, [(2, "late", "en", "s", 1, False), (1, "b\nd", "en", "s", 3, False), (1, "b\nd", "en", "s", 4, False)]), 2)
    assert ids(late.table("blocks"), "raw") == ["b", "d"] and late.table("changes").count() == 0
    back = replacing.merge(r, change(spark, [(2, "back", "en", "other", 3, False)]), 3)
    assert [tuple(x) for x in back.table("changes").collect()] == [(2, "other/2", "added")] and ids(one.table("blocks"), "raw") == ["a", "b", "c"]
    assert replacing.merge(r, change(spark, []), 4).table("blocks").count() == 3


def test_only_touched_parts_are_written(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/r")
    one = replacing.merge(r, change(spark, [(i, f"t{i}", "en", "s", 1, False) for i in range(40)]), parts=8)
    two = replacing.merge(r, change(spark, [(5, "new", "en", "s", 2, False)]))
    moved = [k for k, v in two.entries["blocks"].parts.items() if v != one.entries["blocks"].parts[k]]
    assert len(one.entries["blocks"].parts) == 8 and len(moved) == 1 and two.table("blocks").count() == 40


def block(spark, rows):
    return spark.createDataFrame(rows, "id string, breadcrumb string, raw string")


def hits(df):
    return sorted(tuple(r[c] for c in ("id", "score", "rung", "rank")) for r in df.collect())


def test_segments_find_what_a_rebuilt_index_finds(spark, tmp_path):
    old = [("a", "x", "red fish"), ("b", "x", "blue fish fish"), ("c", "x", "中文 fish"), ("d", "x", "red red")]
    new = [("a", "x", "red bird"), ("e", "y", "fish bird")]
    index = lexical.Index.build(block(spark, old), f"file://{tmp_path}/i")
    after = index.updated(block(spark, new), block(spark, [old[0], old[3]]))
    now = block(spark, [r for r in old if r[0] in "bc"] + new)
    third = after.updated(block(spark, [("d", "z", "red fish again")]), block(spark, [("e", "y", "fish bird")]))
    last = block(spark, [r for r in old if r[0] in "bc"] + new[:1] + [("d", "z", "red fish again")])
    for q in ("red fish", "bird", "中文", "red blue bird", "absent"):
        assert hits(index.search(q, 9)) == hits(lexical.bm25(block(spark, old), q, 9))  # the first version is as it was
        assert hits(after.search(q, 9)) == hits(lexical.bm25(now, q, 9))
        assert hits(third.search(q, 9)) == hits(lexical.bm25(last, q, 9))
    merged = third.merge()
    assert len(merged.segments) == 1 and merged.totals().first() == third.totals().first()
    assert hits(merged.search("red fish", 9)) == hits(lexical.bm25(last, "red fish", 9))
    assert lexical.Index.open(spark, f"file://{tmp_path}/i").segments == merged.segments
    gone = merged.updated(block(spark, []), last)
    assert gone.search("red", 9).count() == 0 and gone.totals().first().n_ == 0


def test_search_reads_the_parts_of_its_terms(spark, tmp_path):
    index = lexical.Index.build(block(spark, [(f"b{i}", "x", f"word{i} common") for i in range(50)]), f"file://{tmp_path}/i", buckets=16)
    parts = index.parts(["word7"], 0)
    files = index.postings(["word7"]).inputFiles()
    assert len(parts) == 1 and files and all(f"part={parts[0]}/" in f for f in files)
    assert len(index.at.entries["postings-0"].parts) > 4


@pytest.mark.parametrize("rungs", [("and", "or", "terms"), ("or",), ("and",)])
def test_batch_equals_single_searches(spark, tmp_path, rungs):
    rows = [("a", "x", "red fish"), ("b", "中文", "blue fish fish red"), ("c", "x", "中文本 fish 中文"), ("d", "x", "Red naïve"), ("e", "x", ""), ("f", "x", "文中 本"), ("g", "x", "red"), ("h", "x", "x1 fish Red fish")]
    b = block(spark, rows)
    index = lexical.Index.build(b, f"file://{tmp_path}/{len(rungs)}{rungs[0]}")
    asked = {1: "red fish", 2: "中文本", 3: "文中 blue", 4: "Red absent", 5: "", 6: "naive fish fish", 7: "本文 absent", 8: "absent", 9: "x1 red fish bird", 10: None}
    got = index.batch(spark.createDataFrame(list(asked.items()), "qid int, text string"), 3, rungs).collect()
    for qid, text in asked.items():
        assert sorted((r.id, r.score, r.rung, r.rank) for r in got if r.qid == qid) == hits(lexical.bm25(b, text or "", 3, rungs)), text


def graph_of(spark):
    blocks = spark.createDataFrame([(f"d{d}/{i}", f"d{d}", f"d{d}#{i % 2}", "wiki" if d == 2 else "raw") for d in range(4) for i in range(d + 2)], "id string, doc_path string, section_id string, layer string")
    links = spark.createDataFrame([("d0/0", "d1/1", 1.0), ("d1/1", "d2/0", 1.0), ("d2/0", "d3/3", 0.5), ("d3/3", "d0/0", 1.0), ("d3/4", "d3/0", 0.0)], "src string, dst string, w double")
    return blocks, links, graph.cliques(blocks, same_doc="doc_path", same_section="section_id")


def test_rank_over_cliques_equals_rank_over_their_pairs(spark):
    blocks, links, members = graph_of(spark)
    pairs = links.unionByName(graph.clique_edges(members))
    want = {(r.src, r.dst): r.weight for k, c in (("same-doc", "doc_path"), ("same-section", "section_id")) for r in graph.structural_edges(blocks, c, k).collect() if k == "same-doc"}
    assert {(r.src, r.dst): r.w for r in graph.clique_edges(members.filter("group like 'same_doc%'")).collect()} == want
    seeds = spark.createDataFrame([(0, "d0/0"), (0, "d2/1"), (1, "d3/2"), (2, "d2/3")], "query int, id string")
    for mode in (None, 1e-6):
        a = {(r["query"], r.id): r.pr for r in graph.personalized_pagerank(links, seeds, 15, mode, members).collect()}
        b = {(r["query"], r.id): r.pr for r in graph.personalized_pagerank(pairs, seeds, 15, mode).collect()}
        assert set(a) == set(b) and max(abs(a[k] - b[k]) for k in a) < 1e-12
    a = {r.id: r.pr for r in graph.pagerank_by_joins(links, seeds.filter("query = 0"), 4, members=members).collect()}
    b = {r.id: r.pr for r in graph.pagerank_by_joins(pairs, seeds.filter("query = 0"), 4).collect()}
    assert set(a) == set(b) and max(abs(a[k] - b[k]) for k in a) < 1e-12 and len(a) == 14


def test_a_large_group_makes_no_pairs(spark):
    n = 20_000
    blocks = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("d").alias("doc_path"), F.lit("raw").alias("layer"))
    members = graph.cliques(blocks, same_doc="doc_path")
    none = spark.createDataFrame([], "src string, dst string, w double")
    got = graph.personalized_pagerank(none, spark.createDataFrame([(0, "7")], "query int, id string"), 5, None, members)
    pr = {r.id: r.pr for r in got.collect()}
    assert len(pr) == n and abs(sum(pr.values()) - 1) < 1e-9 and max(pr, key=pr.get) == "7"


def test_a_registered_base_keeps_its_graph_until_the_corpus_changes(spark, tmp_path):
    docs = [("a.md", "# A\none fish\n\ntwo fish [[b]]", "raw", "A"), ("b.md", "# B\n## Conflicts\n- ⚠ red\n- fine", "wiki", "B")]
    frame = lambda rows: spark.createDataFrame([(*r, {}) for r in rows], "path string, text string, layer string, title string, fm map<string, array<string>>")
    base = KnowledgeBase.from_documents(spark, frame(docs)).registered(f"file://{tmp_path}/r")
    first = [tuple(r) for r in base.search("fish").collect()]
    version = base.registry.snapshot().version
    assert [tuple(r) for r in base.search("fish").collect()] == first and base.registry.snapshot().version == version > 0
    changed = KnowledgeBase.from_documents(spark, frame([("a.md", "# A\none fish", "raw", "A"), docs[1]])).registered(f"file://{tmp_path}/r")
    assert changed.stamp() != base.stamp() and changed.graph()[1].count() == 4 and changed.registry.snapshot().version > version
    assert {(r.kind, r.subject) for r in base.lint(F.lit("2024-01-01").cast("date")).collect()} >= {("conflict", "b.md")}


def test_kept_index_is_built_once_for_a_state_of_the_files(spark, tmp_path):
    made = []

    def some():
        made.append(1)
        return spark.createDataFrame([("a#s/0", "s", "red fox"), ("b#s/0", "s", "blue fox runs")], "id string, breadcrumb string, raw string")

    path = f"file://{tmp_path}/index"
    for _ in range(2):
        index = lexical.Index.kept(spark, path, some)
        assert [(r.id, r.raw) for r in index.hits("blue fox", 5, ("and",)).collect()] == [("b#s/0", "blue fox runs")]
    assert made == [1] and index.hits("nowhere", 5).count() == 0
    rival = lexical.Index.build(some(), f"file://{tmp_path}/other")
    assert lexical.Index.kept(spark, f"file://{tmp_path}/other", some).at.version == rival.at.version
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    first = file_stamp(spark, f"file://{tmp_path}/t.parquet")
    assert first == file_stamp(spark, f"file://{tmp_path}/t.parquet")
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert first != file_stamp(spark, f"file://{tmp_path}/t.parquet")
