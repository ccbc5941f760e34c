"""Stale derived pages made anew from the blocks that they record, all or nothing page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import compile, ingest

# How a page records its evidence, in this order.
RAW_LINK = r"\[\[raw/([^\]|]+)(?:\|[^\]]*)?\]\]"
EVIDENCE_LINE = r"(?m)^- `([^`\r\n]+)`\s+—"
SOURCES, POINTS, EVIDENCE, FACTS, ENTITIES = 5, 12, 20, 8, 10


def field(front: Column, key: str) -> Column:
    """A top-level value of a page's front matter; null where it isn't there."""
    return F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{key}:(.*)$", 1)), F.lit(""))


def recorded(pages: DataFrame) -> DataFrame:
    """`pages` (path, content) with kind, title, created, entities and `ids`: what the page was made from, in order.

    Ids come from the front matter's sources, then from links in the body, then, for briefs, from the list of evidence;
    each once.  `ids` is null where the page can't be replayed: not generated, of another type, without a title or
    sources, with a source that isn't a raw block, or a synthesis without a list of entities."""
    front, rest = ingest.frontmatter(F.col("content")), ingest.body(F.col("content"))
    rows = pages.withColumns({"kind": field(front, "type"), "created": field(front, "created"), "title": F.nullif(F.trim(F.regexp_extract(rest, r"(?m)^# (.*)$", 1)), F.lit("")), "listed": F.regexp_extract(front, r"(?m)^sources: *\[(.*)\] *$", 1)})
    listed = F.filter(F.transform(F.split("listed", ","), lambda s: F.trim(s)), lambda s: s != "")
    named = F.transform(listed, lambda s: F.regexp_replace(s, "^raw/", ""))
    seen = F.when(F.col("kind") == "brief", F.regexp_extract_all(rest, F.lit(EVIDENCE_LINE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    ids = F.array_distinct(F.filter(F.transform(F.concat(named, F.regexp_extract_all(rest, F.lit(RAW_LINK), F.lit(1)), seen), lambda s: F.trim(s)), lambda s: s != ""))
    about = F.regexp_extract(rest, r"(?s)## Entities\n(.*?)(?:\n## |\z)", 1)
    good = (field(front, "generated") == "true") & F.col("kind").isin("brief", "synthesis") & F.col("title").isNotNull() & (F.size(listed) > 0) & F.forall(listed, lambda s: s.startswith("raw/"))
    good = good & ((F.col("kind") == "brief") | rest.contains("## Entities\n"))
    return rows.withColumns({"ids": F.when(F.coalesce(good, F.lit(False)), ids), "entities": F.array_distinct(F.regexp_extract_all(about, F.lit(r"\[\[entities/([^\]]+)\]\]"), F.lit(1)))}).drop("listed")


def _front(kind: str, e: Column, n: int, stamp: str, created: Column) -> Column:
    sources = F.array_join(F.transform(F.slice(e, 1, n), lambda x: F.concat(F.lit("raw/"), x["id"])), ", ")
    made = F.when(created.isNotNull(), F.concat(F.lit("created: "), created, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"---\ntype: {kind}\ngenerated: true\n"), made, F.lit("sources: ["), sources, F.lit(f"]\nlast_compiled: {stamp}\nstale: false\nconfidence: draft\n---\n# "), F.col("title"))


def brief_page(e: Column, stamp: str) -> Column:
    """A brief of evidence (array of id, raw, breadcrumb): two sentences a block, one of each beginning, and its sources."""
    points = F.flatten(F.transform(e, lambda x: F.transform(X.brief_sentences(x["raw"], 2), lambda s: F.struct(s.alias("s"), x["id"].alias("id")))))
    keys = F.transform(points, lambda p: F.substring(p["s"], 1, 40))
    once = F.slice(F.filter(points, lambda p, i: F.array_position(keys, F.substring(p["s"], 1, 40)) == i + 1), 1, POINTS)
    listed = F.transform(F.slice(e, 1, EVIDENCE), lambda x: F.concat(F.lit("- `"), x["id"], F.lit("` — "), x["breadcrumb"]))
    said = compile.bullets(once, lambda p: F.concat(F.lit("- "), p["s"], F.lit(" [[raw/"), p["id"], F.lit("]]")))
    return F.concat(_front("brief", e, SOURCES, stamp, F.col("created")), F.lit("\n\n## Points\n"), said, F.lit("\n\n## Evidence ("), F.size(e).cast("string"), F.lit(")\n"), F.array_join(listed, "\n"), F.lit("\n"))


def synthesis_page(e: Column, stamp: str) -> Column:
    """A synthesis of evidence: the first facts with their blocks, and the entities that the page had."""
    facts = compile.bullets(F.slice(e, 1, FACTS), lambda x: F.concat(F.lit("- "), F.regexp_replace(x["raw"], "\n", " "), F.lit(" [[raw/"), x["id"], F.lit("]]")))
    about = compile.bullets(F.slice("entities", 1, ENTITIES), lambda x: F.concat(F.lit("- [[entities/"), x, F.lit("]]")))
    return F.concat(_front("synthesis", e, 3, stamp, F.col("created")), F.lit("\n\n## Facts\n"), facts, F.lit("\n\n## Entities\n"), about, F.lit("\n\n## Conflicts\n- none\n"))


def rebuild_stale(pages: DataFrame, blocks: DataFrame, stamp: str) -> DataFrame:
    """path, content, stale, state, rebuilt of all pages (path, content, stale, state).

    Stale pages directly below `synthesis/` that can be replayed, all of whose recorded blocks exist, get a new text from
    the blocks as they are now, and are stale no more; what people set on them (confidence, conflicts) and their state
    stay.  All other pages keep their text and their flag: a missing block leaves the whole page as it was."""
    rows = recorded(pages)
    todo = rows.filter(F.col("stale") & F.col("path").rlike(r"^synthesis/[^/]+\.md$") & F.col("ids").isNotNull())
    wanted = todo.select("path", F.posexplode("ids").alias("pos", "id"))
    met = wanted.join(blocks.select("id", "raw", "breadcrumb"), "id", "left")
    e = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "raw", "breadcrumb"))), lambda x: F.struct(x["id"].alias("id"), x["raw"].alias("raw"), F.coalesce(x["breadcrumb"], F.lit("")).alias("breadcrumb")))
    whole = met.groupBy("path").agg(F.count_if(F.col("raw").isNull()).alias("missing"), e.alias("e")).filter("missing = 0")
    made = todo.join(whole.select("path", "e"), "path").withColumn("fresh", F.when(F.col("kind") == "brief", brief_page(F.col("e"), stamp)).otherwise(synthesis_page(F.col("e"), stamp)))
    carried = compile.carry_forward(made.filter("kind = 'synthesis'").select("path", F.col("fresh").alias("content")), todo.select("path", "content"))
    fresh = made.filter("kind = 'brief'").select("path", F.col("fresh").alias("new")).unionByName(carried.select("path", F.col("content").alias("new")))
    out = pages.join(fresh, "path", "left")
    return out.select("path", F.coalesce("new", "content").alias("content"), (F.col("stale") & F.col("new").isNull()).alias("stale"), "state", F.col("new").isNotNull().alias("rebuilt"))
