import pytest

from tessera.operators import ledger, rebuild
from tessera.sources.registry import Entry, Registry


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, "id string, hash string")


def test_verdicts_are_recorded_first_and_hold_for_the_words_that_were_judged(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/r")
    b = blocks_of(spark, [("a", "1"), ("b", "2"), ("c", "3")])
    ask = lambda rows: spark.createDataFrame(rows, "id string, state string, reason string, updated string")
    for wrong in ([("zz", "retracted", "x", "1")], [("a", "gone", "x", "1")], [("a", None, "x", "1")]):
        with pytest.raises(ValueError):
            ledger.decide(r, ask(wrong), b)
    assert ledger.verdicts(r.snapshot()).count() == 0 and r.versions() == []
    one = ledger.decide(r, ask([("a", "retracted", "wrong", "1"), ("a", "disputed", "early", "0"), ("b", "superseded", "old", "1")]), b)
    two = ledger.decide(r, ask([("b", "retracted", "later", "2"), ("c", "disputed", "new", "2")]), b)
    assert sorted((x.id, x.state) for x in ledger.verdicts(one).collect()) == [("a", "retracted"), ("b", "superseded")]
    pages = spark.createDataFrame([("p", "see [[a]] and [[c]] and [[a]]"), ("q", "see [[b]]"), ("s", "no link"), ("t", None)], "page string, text string")
    states, stale = ledger.replay(two, blocks_of(spark, [("a", "1"), ("b", "changed"), ("c", "3")]), pages)
    assert sorted((x.id, x.state, x.reason) for x in states.collect()) == [("a", "retracted", "wrong"), ("c", "disputed", "new")]
    assert [tuple(x) for x in stale.collect()] == [("p", "cited retracted a: wrong", 2)]


def test_a_ledger_of_another_form_is_an_error(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/r")
    b = blocks_of(spark, [("a", "1")])
    now = ledger.decide(r, spark.createDataFrame([("a", "draft", "", "1")], "id string, state string, reason string, updated string"), b)
    e = now.entries["ledger"]
    other = r.publish(now, {"ledger": Entry(e.parts, e.schema, "", {"version": 2})})
    with pytest.raises(ValueError):
        ledger.verdicts(other)


BRIEF = "---\ntype: brief\ngenerated: true\ncreated: 2020-01-01\nsources: [raw/b1, raw/b2]\nstale: true\n---\n# Title\n\n## Points\n- old [[raw/b2]]\n- old [[raw/b3|shown]]\n\n## Evidence (9)\n- `b4` — x\n"
SYNTHESIS = "---\ntype: synthesis\ngenerated: true\nsources: [raw/b1]\nconfidence: high\n---\n# S\n\n## Facts\n- `b9` — not evidence here [[raw/b2]]\n\n## Entities\n- [[entities/x]]\n- [[entities/y]]\n- [[entities/x]]\n\n## Conflicts\n- ⚠ they differ\n"


def test_stale_pages_are_made_anew_or_left_alone(spark):
    blocks = spark.createDataFrame([("b1", "One. Two! Three.", "A > B"), ("b2", "Two words.\nline", "C"), ("b3", "One. Other.", None), ("b4", "", "D")], "id string, raw string, breadcrumb string")
    pages = {
        "synthesis/brief.md": (BRIEF, True, "disputed"),
        "synthesis/s.md": (SYNTHESIS, True, "active"),
        "synthesis/fresh.md": (BRIEF, False, "active"),
        "synthesis/lost.md": (BRIEF.replace("b4", "gone"), True, "active"),
        "synthesis/human.md": (BRIEF.replace("generated: true", "generated: false"), True, "active"),
        "synthesis/map.md": (BRIEF.replace("type: brief", "type: mindmap"), True, "active"),
        "synthesis/none.md": (BRIEF.replace("[raw/b1, raw/b2]", "[]"), True, "active"),
        "synthesis/other.md": (BRIEF.replace("raw/b1,", "b1,"), True, "active"),
        "synthesis/untitled.md": (BRIEF.replace("# Title", "Title"), True, "active"),
        "synthesis/deep/x.md": (BRIEF, True, "active"),
        "entities/e.md": (BRIEF, True, "active"),
        "synthesis/bare.md": (None, True, "active"),
    }
    df = spark.createDataFrame([(k, *v) for k, v in pages.items()], "path string, content string, stale boolean, state string")
    got = {r.path: r for r in rebuild.rebuild_stale(df, blocks, "now").collect()}
    assert {k for k, r in got.items() if r.rebuilt} == {"synthesis/brief.md", "synthesis/s.md"}
    for k, (content, stale, state) in pages.items():
        assert got[k].state == state and (got[k].rebuilt or (got[k].content, got[k].stale) == (content, stale)), k
    brief = got["synthesis/brief.md"]
    assert not brief.stale and "sources: [raw/b1, raw/b2, raw/b3, raw/b4]" in brief.content and "created: 2020-01-01\n" in brief.content and "stale: false" in brief.content
    assert "- One. [[raw/b1]]\n- Two! [[raw/b1]]\n- Two words. [[raw/b2]]\n- line [[raw/b2]]\n- Other. [[raw/b3]]\n" in brief.content  # `One.` once
    assert "## Evidence (4)\n- `b1` — A > B\n- `b2` — C\n- `b3` — \n- `b4` — D\n" in brief.content
    s = got["synthesis/s.md"].content
    assert "confidence: high" in s and "- ⚠ they differ" in s and "- [[entities/x]]\n- [[entities/y]]\n" in s and "- Two words. line [[raw/b2]]" in s and "b9" not in s
    again = df.limit(0).unionByName(spark.createDataFrame([("synthesis/brief.md", brief.content, True, "active")], df.schema))
    assert rebuild.rebuild_stale(again, blocks, "now").first().content == brief.content  # what is made anew can be made anew


def test_pages_of_documents_show_summary_questions_and_sections(spark):
    from tessera.operators import compile

    docs = spark.createDataFrame([("a.md", "A"), ("b.md", None), ("none.md", "N")], "path string, title string")
    rows = [("a.md", 0, f"a.md#{i}", f"Piece {i}.", "A > H", "raw") for i in range(400)] + [("b.md", 0, "b.md/0", "x" * 300, "B > Last", "raw"), ("b.md", 1, "b.md/1", "", "B", "raw"), ("a.md", 0, "w", "wiki", "", "wiki")]
    blocks = spark.createDataFrame(rows, "doc_path string, ordinal int, id string, raw string, breadcrumb string, layer string")
    sections = spark.createDataFrame([("a.md#H", "a.md", "H", 0), ("a.md#p", "a.md", "p. 1", 1), ("a.md#_", "a.md", "__x", 2)], "id string, doc_path string, title string, ordinal int")
    got = {r.path: r.content for r in compile.navigation_pages(docs, blocks, sections, "now").collect()}
    assert set(got) == {"sources/a.md.md", "sources/b.md.md"}
    a, b = got["sources/a.md.md"], got["sources/b.md.md"]
    assert "## Questions\n- What does the document say about “H”? (a.md#H)\n\n## Sections\n- H (`a.md#H`)\n- p. 1 (`a.md#p`)\n" in a
    assert 200 < len(a.split("## Summary\n")[1].split("\n")[0]) <= 280
    assert "# b.md\n\n## Summary\n\n\n## Questions\n- What does “Last” hold? (b.md/0)\n\n## Sections\n- none\n" in b


def test_assertions_states_and_coverage(spark):
    from tessera.functions import text as X
    from tessera.operators import lifecycle, quality

    raw = "- said\n* # head\n- [[x]] cited\n-- | table\n- `code`\n- > quote\n- ---\nplain\n  - \tinner \n-"
    b = spark.createDataFrame([("a", raw, "wiki"), ("b", "- said", "raw")], "id string, raw string, layer string")
    assert [(r.id, r.content) for r in quality.assertions(b).collect()] == [("a", "said"), ("a", "inner")]
    pages = spark.createDataFrame([("wiki/p", "disputed", False, "old"), ("q", "active", True, "was")], "doc_path string, state string, stale boolean, reason string")
    marks = spark.createDataFrame([("./p", "why"), ("p", "because"), ("new", "n")], "page string, reason string")
    assert [tuple(r) for r in lifecycle.mark_stale(pages, marks).collect()] == [("new", "active", True, "n"), ("p", "disputed", True, "because"), ("q", "active", True, "was")]
    assert [tuple(r)[:3] for r in lifecycle.mark_stale(pages, spark.createDataFrame([("q", "recompiled")], "page string, reason string"), clear=True).collect()] == [("p", "disputed", False), ("q", "active", False)]
    rows = spark.createDataFrame([("a", "d.md"), ("b", "sources/d.md"), ("c", "e.md")], "id string, doc_path string")
    docs = spark.createDataFrame([("d.md", "retracted"), ("e.md", "active"), ("f.md", None)], "path string, state string")
    assert sorted(tuple(r) for r in lifecycle.declared_states(rows, docs).collect()) == [("a", "retracted"), ("b", "retracted")]
    got = lifecycle.vector_coverage(spark.createDataFrame([("a", "x"), ("b", " \t"), ("c", None), ("d", "y")], "id string, raw string"), spark.createDataFrame([("a",), ("a",), ("z",)], "id string")).first()
    assert tuple(got) == (2, 1, 1)
    for text, want in (("中文 ab", "en"), ("中文字 ab", "zh"), ("", "en"), ("㐀㐁 a", "zh")):
        from pyspark.sql import functions as F

        assert spark.range(1).select(X.instruction_language(F.lit(text))).first()[0] == want


def test_unused_readers(spark, tmp_path):
    from pyspark.sql import types as T

    from tessera.sources import tables

    content = spark.createDataFrame([("a", b"x"), ("b", b"y")], "path string, content binary")
    known = tables.new_only(content, spark.createDataFrame([], "path string, sha string")).filter("path = 'a'")
    assert [r.path for r in tables.new_only(content, known).collect()] == ["b"]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tag", T.StringType())])
    assert [tuple(r) for r in tables.with_defaults(spark.createDataFrame([(1, 9)], "id int, gone int"), schema, {"tag": "t"}).collect()] == [(1, "t")]
    tables.export_tables({"t": spark.range(3)}, f"{tmp_path}/out")
    assert tables.import_tables(spark, f"{tmp_path}/out", ["t"])["t"].count() == 3
    with pytest.raises(Exception):
        tables.export_tables({"t": spark.range(3)}, f"{tmp_path}/out")
    (tmp_path / "topics.tsv").write_text('1\twhat "is" it\n')
    (tmp_path / "qrels.tsv").write_text("1\tq\td1\t1\n1\tq\td2\t0\n")
    (tmp_path / "corpus.jsonl").write_text('{"docid": "d1", "title": "t", "text": "x"}\n')
    topics, gold, corpus = tables.evaluation(spark, f"{tmp_path}/topics.tsv", f"{tmp_path}/qrels.tsv", f"{tmp_path}/corpus.jsonl")
    assert topics.first().text == 'what "is" it' and [tuple(r) for r in gold.collect()] == [("1", "d1")] and corpus.first().docid == "d1"
