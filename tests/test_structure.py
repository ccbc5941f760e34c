import random
import time

import pytest

from tessera.operators import compile, containment, graph, ingest


def slow_parse(path, text, first):
    """Headings by looking at all earlier ones; blocks as runs of lines."""
    heads, rows, number, run = [], {}, first, []
    sections, blocks = {}, {}

    def trail():
        out = []
        for k, (level, title) in enumerate(heads):
            if all(later > level for later, _ in heads[k + 1 :]):
                out.append(title)
        return out

    def close():
        nonlocal number
        if run:
            t = trail()
            at = f"{path}#{'/'.join(t)}" if heads else path
            blocks[f"{at}/{number}"] = (f"{at}/{number}", at if heads else None, "/".join(t) if heads else None, "\n".join(run), number)
            number += 1
            run.clear()

    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("#"):
            close()
            title = line.lstrip("#")
            heads.append((min(6, len(line) - len(title)), title.strip()))
            number = first
            t = trail()
            key = f"{path}#{'/'.join(t)}"
            sections[key] = (key, f"{path}#{'/'.join(t[:-1])}" if len(t) > 1 else None, t[-1], len(heads) - 1)
        elif line:
            run.append(line)
        else:
            close()
    close()
    del rows
    return sections, blocks


@pytest.mark.parametrize("seed", range(6))
def test_one_walk_equals_a_slow_parser(seed):
    r = random.Random(seed)
    lines = [r.choice(["# a", "## b", "### c", "##### d", "######## e", "#", "## ", "# x/y", "text", "  more text ", "", "", "- item", "\t# b", "a # b"]) for _ in range(120)]
    text = "\n".join(lines)
    for first in (0, 1):
        sections, blocks = ingest.fold_document("d.md", text, first)
        want_sections, want_blocks = slow_parse("d.md", text, first)
        assert {s[0]: (s[0], s[1], s[2], s[4]) for s in sections} == want_sections
        assert {b[0]: b for b in blocks} == want_blocks
        for s in sections:
            assert s[3] == (want_blocks[f"{s[0]}/{first}"][3].replace("\n", " ")[:160] if f"{s[0]}/{first}" in want_blocks else "")


def test_a_hundred_thousand_headings_take_seconds(spark):
    text = "\n".join(f"{'#' * (1 + i % 5)} h{i}\nline {i}" for i in range(100_000))
    began = time.time()
    sections, blocks = ingest.parse(spark.createDataFrame([("a.md", text, "raw")], "path string, text string, layer string"))
    assert sections.count() == 100_000 and blocks.count() == 100_000 and time.time() - began < 60


def test_titles_null_texts_and_tables(spark):
    docs = [("a.md", "---\ntitle: The A\n---\nbefore\n# H\n| x |\n\n1. one\n- two", "raw"), ("b.md", None, "raw"), ("c.md", "", "wiki"), ("d.md", "only", "wiki")]
    sections, blocks = ingest.parse(spark.createDataFrame(docs, "path string, text string, layer string"), first=1, titled=True)
    got = {r.id: (r.section_id, r.breadcrumb, r.type, r.layer) for r in blocks.collect()}
    assert got == {"a.md/1": ("a.md", "The A", "paragraph", "raw"), "a.md#H/1": ("a.md#H", "The A > H", "table", "raw"), "a.md#H/2": ("a.md#H", "The A > H", "list", "raw"), "d.md/1": ("d.md", "d.md", "paragraph", "wiki")}
    assert [(r.id, r.summary) for r in sections.collect()] == [("a.md#H", "| x |")]


@pytest.mark.parametrize("seed", range(3))
def test_containment_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé中") for _ in range(n))
    texts = [(i, word(r.randint(0, 14))) for i in range(80)] + [(80, None), (81, "ab" * 40), (1, "again")]
    needles = sorted({word(r.randint(1, 6)) for _ in range(60)} | {"", "abab", "zz", "a"})
    t = spark.createDataFrame([(*x, "q") for x in texts], "id int, text string, needle string")
    n = spark.createDataFrame([(x,) for x in needles] + [("a",), (None,)], "needle string")
    got = sorted((x.id, x.needle) for x in containment.contained(n, t.select("id", "text")).collect())
    assert got == sorted({(i, x) for i, v in texts if v is not None for x in needles if x and x in v})
    got = sorted((x.id, x.needle) for x in containment.ending(n, t.select("id", "text"), longest=3).collect())
    assert got == sorted({(i, x) for i, v in texts if v is not None for x in needles if x and v.endswith(x)})
    assert containment.contained(n.limit(0), t.select("id", "text")).count() == 0


def test_links_by_containment_come_last(spark):
    blocks = spark.createDataFrame([("p.md#Alpha Beta/0", "p.md", "p.md#Alpha Beta", "raw", "see [[alpha]] and [[q]] and [[nowhere]] and [[Alpha Beta]]"), ("q.md#Alphabet/0", "q.md", "q.md#Alphabet", "raw", "x"), ("q.md#Other/0", "q.md", "q.md#Other", "raw", "y")], "id string, doc_path string, section_id string, layer string, raw string")
    docs = spark.createDataFrame([("p.md", "P"), ("q.md", "Q")], "path string, title string")
    sections = spark.createDataFrame([("p.md#Alpha Beta", "p.md", "Alpha Beta"), ("q.md#Alphabet", "q.md", "Alphabet"), ("q.md#Other", "q.md", "Other")], "id string, doc_path string, title string")
    got = {(r.src[0], r.dst, r.kind) for r in graph.resolve_links(blocks, docs, sections, contains=True).collect()}
    assert got == {("p", "q.md#Alphabet/0", "wikilink"), ("p", "q.md#Other/0", "wikilink"), ("p", "nowhere", "wikilink-unresolved")}


def test_concepts_and_entities_by_containment(spark):
    blocks = spark.createDataFrame([("Heat flows",), ("heat",), ("ab",)], "raw string")
    concepts = spark.createDataFrame([("c1", "Reheating of rivers"), ("c2", "the HEAT flows"), ("c3", "nothing"), ("c4", None)], "concept string, summary string")
    assert [tuple(r) for r in compile.near_concepts(blocks, concepts).orderBy("concept").collect()] == [("c1", 1), ("c2", 2)]
    found = spark.createDataFrame([("acme",), ("me",), ("bank",)], "entity_id string")
    pages = spark.createDataFrame([("entities/ACME.md",), ("entities/bank.txt",), (None,)], "doc_path string")
    assert sorted(r.entity_id for r in compile.affected_entities(found, pages).collect()) == ["acme", "me"]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_chains_over_ranges_equal_chains_in_groups(spark, parts):
    from collections import Counter

    from tessera.operators import chains

    r = random.Random(parts)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None, ""]), r.randint(0, 300)) for _ in range(800)] + [("c", 1), ("c", 1), ("d", None), ("d", 4)]
    df = spark.createDataFrame([(*x, "y") for x in rows], "g string, i long, next string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(x) for x in chains.successors(df, "g", "i").collect()]
        assert chains.successors(df.limit(0), "g", "i").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for g in {x[0] for x in rows}:
        items = sorted((x[1] for x in rows if x[0] == g), key=lambda v: (v is not None, v or 0))
        want += [(g, a, b) for a, b in zip(items, [*items[1:], None])]
    assert Counter(got) == Counter(want)
