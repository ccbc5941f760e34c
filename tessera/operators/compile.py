"""Derived pages: entities, sources, briefs, mind maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.containment import contained, ending, plain
from tessera.session import stored

# The shapes of names.  Words of capitals, capitalised runs, organisations.
CAPITALS = r"(?:^|[^\p{L}\p{N}_])([A-Z]{2,})(?=$|[^\p{L}\p{N}_])"
RUNS = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?: [A-Z][a-z]+)+)(?=$|[^\p{L}\p{N}_])"
ORGS = rf"([{X.HAN}]{{2,8}}(?:{X.ORG_SUFFIXES}))"


def mentions(blocks: DataFrame, patterns: tuple[str, ...] = (CAPITALS, RUNS, ORGS)) -> DataFrame:
    """id, doc_path, ordinal, name, entity_id: a row per match."""
    found = F.flatten(F.array(*(F.regexp_extract_all("raw", F.lit(p), F.lit(1)) for p in patterns)))
    rows = blocks.select("id", "doc_path", "ordinal", "raw", F.explode(found).alias("name"))
    return rows.select("id", "doc_path", "ordinal", "name", X.slug("name").alias("entity_id"), F.substring(F.regexp_replace("raw", "\n", " "), 1, 160).alias("fact"))


def entities(found: DataFrame, facts: int = 8) -> DataFrame:
    """entity_id, name (of the first document), aliases, n_facts and the first facts over all documents."""
    first = F.min(F.struct("doc_path", "ordinal", "name"))
    by = found.groupBy("entity_id").agg(first.alias("f"), F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("n_facts"))
    top = found.select("entity_id", "doc_path", "ordinal", "id", "fact").withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy("doc_path", "ordinal", "id", "fact"))).filter(F.col("rn") <= facts)
    some = top.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("evidence"))
    name = F.col("f.name")
    return by.join(some, "entity_id").select("entity_id", name.alias("name"), F.filter("names", lambda x: x != F.col("f.name")).alias("aliases"), "n_facts", "evidence")


def source_pages(blocks: DataFrame, limit: int = 280) -> DataFrame:
    """path, content: a page per document with a summary of its blocks in order."""
    raws = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "raw"))), lambda x: x["raw"])
    pieces = F.flatten(F.transform(raws, lambda r: F.filter(F.transform(F.split(r, r"(?<=[。！？；!?;.])\s*|\n+"), lambda s: F.trim(s)), lambda s: s != "")))
    pages = blocks.groupBy("doc_path").agg(X.summary(pieces, limit).alias("summary"), F.count("*").alias("n_blocks"))
    content = F.concat(F.lit("# "), "doc_path", F.lit("\n\n"), "summary", F.lit("\n"))
    return pages.select(F.concat(F.lit("sources/"), "doc_path", F.lit(".md")).alias("path"), content.alias("content"), "summary", "n_blocks")


def navigation_pages(documents: DataFrame, blocks: DataFrame, sections: DataFrame, stamp: str, limit: int = 280, questions: int = 5) -> DataFrame:
    """path, content of a page for every document (path, title) of the raw layer with blocks: a summary, questions that
    the document answers, and its sections, each with its address.

    Questions come from section titles that aren't technical (`__`, `p.`), without any from the last headings of the first
    blocks; of a document only the first `questions` of these and the pieces that fit the summary are kept."""
    raw = blocks.filter("layer = 'raw'").select("doc_path", "ordinal", "id", "raw", "breadcrumb")
    pieces = F.filter(F.transform(F.split("raw", r"(?<=[。！？；!?;.])\s*|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    w = Window.partitionBy("doc_path").orderBy("ordinal", "id")
    # every block adds a character at least, so the first `limit` of a document are all that a page can show
    first = raw.withColumn("p", F.slice(pieces, 1, limit)).filter(F.size("p") > 0).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(limit, questions))
    size = F.aggregate("p", F.lit(0), lambda a, s: a + F.length(s) + 1)
    rows = first.withColumn("before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = rows.filter((F.col("before") <= limit) | (F.col("rn") <= questions))
    item = F.struct("rn", "p", F.concat(F.lit("- What does “"), F.substring_index("breadcrumb", " > ", -1), F.lit("” hold? ("), "id", F.lit(")")).alias("q"))
    own = near.groupBy("doc_path").agg(F.array_sort(F.collect_list(item)).alias("b"))
    named = sections.filter(~F.col("title").startswith("__"))
    ws = Window.partitionBy("doc_path").orderBy("ordinal", "id")
    asked = named.filter(~F.col("title").startswith("p.")).withColumn("rn", F.row_number().over(ws)).filter(F.col("rn") <= questions)
    asked = asked.groupBy("doc_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title", "id"))), lambda x: F.concat(F.lit("- What does the document say about “"), x["title"], F.lit("”? ("), x["id"], F.lit(")"))).alias("asked"))
    listed = named.groupBy("doc_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "title"))), lambda x: F.concat(F.lit("- "), x["title"], F.lit(" (`"), x["id"], F.lit("`)"))).alias("listed"))
    all_ = documents.select(F.col("path").alias("doc_path"), "title").join(own, "doc_path").join(asked, "doc_path", "left").join(listed, "doc_path", "left")
    said = F.coalesce("asked", F.transform(F.filter("b", lambda x: x["rn"] <= questions), lambda x: x["q"]))
    content = F.concat(F.lit("---\ntype: source\ngenerated: true\nsource: raw/"), "doc_path", F.lit(f"\nlast_compiled: {stamp}\n---\n# "), F.coalesce("title", "doc_path"), F.lit("\n\n## Summary\n"), X.summary(F.flatten(F.transform("b", lambda x: x["p"])), limit), F.lit("\n\n## Questions\n"), F.array_join(said, "\n"), F.lit("\n\n## Sections\n"), F.coalesce(F.array_join("listed", "\n"), F.lit("- none")), F.lit("\n"))
    return all_.select(F.concat(F.lit("sources/"), "doc_path", F.lit(".md")).alias("path"), content.alias("content"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as a table of (path, content), partitioned by their first folder."""
    pages.select("path", "content", F.substring_index("path", "/", 1).alias("kind")).write.mode("overwrite").partitionBy("kind").parquet(folder)


def brief(blocks: DataFrame, per_block: int = 2, bullets: int = 12) -> DataFrame:
    """doc_path, position, bullet: the first sentences of each block, one of each beginning of 40 characters."""

    rows = blocks.select("doc_path", "ordinal", "id", F.posexplode(X.brief_sentences("raw", per_block)).alias("p", "s"))
    order = ("ordinal", "id", "p")
    first = rows.withColumn("k", F.substring("s", 1, 40)).withColumn("rn", F.row_number().over(Window.partitionBy("doc_path", "k").orderBy(*order))).filter("rn = 1")
    pos = F.row_number().over(Window.partitionBy("doc_path").orderBy(*order))
    return first.withColumn("position", pos).filter(F.col("position") <= bullets).select("doc_path", "position", F.col("s").alias("bullet"))


def mindmap(sections: DataFrame, branches: int = 12, leaves: int = 6) -> DataFrame:
    """parent, position, titles: section titles under their parents, parents in the order first seen."""
    clean = F.trim(F.regexp_replace("title", r"[\[\](){}]", " "))
    rows = sections.filter("parent_id is not null").select(F.col("parent_id").alias("parent"), "ordinal", clean.alias("t"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("parent").orderBy("ordinal", "t"))).filter(F.col("rn") <= max(leaves, 1))
    by = first.groupBy("parent").agg(F.min("ordinal").alias("seen"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "t"))), lambda x: x["t"]), 1, leaves).alias("titles"))
    top = by.orderBy("seen", "parent").limit(branches)

    return top.withColumn("position", F.row_number().over(Window.orderBy("seen", "parent"))).drop("seen")


def rebuildable(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, wanted, found, ok: a page is rebuilt only if every recorded block (page, id) exists."""
    return pages.join(blocks.select("id", F.lit(1).alias("hit")), "id", "left").groupBy("page").agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("ok", F.col("wanted") == F.col("found"))


def affected_concepts(blocks: DataFrame, concepts: DataFrame, top: int = 10) -> DataFrame:
    """concept, hits: concepts (concept, summary) by how many distinct terms of the blocks their summary holds.

    Terms are matched by equality with the summary's own terms, so no pair of block and concept is formed."""
    terms = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))))
    have = blocks.select(terms("raw").alias("term")).distinct()
    return concepts.select("concept", terms("summary").alias("term")).join(have, "term").groupBy("concept").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "concept").limit(top)


def near_concepts(blocks: DataFrame, concepts: DataFrame, top: int = 10) -> DataFrame:
    """concept, hits: as `affected_concepts`, but a term counts wherever the summary contains it, inside words too.

    A term is letters and digits, so it lies within one word of a summary: terms are looked for in the distinct words of all
    summaries, whose number grows with the vocabulary, and concepts meet the words after."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))
    terms = blocks.select(words("raw").alias("needle")).distinct()
    held = stored(concepts.select("concept", words("summary").alias("word")).distinct())
    found = contained(terms, held.select("word", F.col("word").alias("text")).distinct(), "word")
    hits = held.join(found, "word").select("concept", "needle").distinct().groupBy("concept").agg(F.count("*").alias("hits"))
    return hits.orderBy(F.desc("hits"), F.asc_nulls_last("concept")).limit(top)


def affected_entities(found: DataFrame, pages: DataFrame) -> DataFrame:
    """entity_id of the mentioned entities that have a page: a page whose path (doc_path) ends in the id and `.md`, A-Z in
    either case; a longer name with that ending counts."""
    names = found.select(plain(F.concat("entity_id", F.lit(".md"))).alias("needle"), "entity_id").distinct()
    met = ending(names, pages.select(F.col("doc_path").alias("id"), plain("doc_path").alias("text")).distinct())
    return names.join(met.select("needle").distinct(), "needle", "left_semi").select("entity_id").distinct()


def bullets(items, line):
    """Lines of a list, each made by `line`, joined; a placeholder where there are none."""
    return F.when(F.size(items) == 0, F.lit("- none")).otherwise(F.array_join(F.transform(items, line), "\n"))


def entity_pages(found: DataFrame, facts: int = 8, aliases: int = 5) -> DataFrame:
    """path, content of a page per entity: a draft with its aliases and its first facts and their citations."""
    w = Window.partitionBy("entity_id").orderBy("doc_path", "ordinal", "id", "fact")
    top = found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= facts)
    by = top.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "fact", "id"))), lambda x: F.struct(x["fact"].alias("fact"), x["id"].alias("id"))).alias("facts"))
    names = found.groupBy("entity_id").agg(F.min(F.struct("doc_path", "ordinal", "name"))["name"].alias("name"), F.array_sort(F.collect_set("name")).alias("names"))
    rows = by.join(names, "entity_id").withColumn("aliases", F.slice(F.filter("names", lambda x: x != F.col("name")), 1, aliases))
    content = F.concat(F.lit("---\nconfidence: draft\n---\n# "), "name", F.lit("\n\n## Aliases\n"), bullets(F.col("aliases"), lambda a: F.concat(F.lit("- "), a)), F.lit("\n\n## Facts\n"), bullets(F.col("facts"), lambda x: F.concat(F.lit("- "), x["fact"], F.lit(" [["), x["id"], F.lit("]]"))), F.lit("\n\n## Conflicts\n- none\n"))
    return rows.select(F.concat(F.lit("entities/"), "entity_id", F.lit(".md")).alias("path"), content.alias("content"))


def confidence_of(content):
    return F.coalesce(F.nullif(F.regexp_extract(content, r"(?m)\A---\n(?:.*\n)*?confidence: *(\w+)", 1), F.lit("")), F.lit("draft"))


def conflicts_of(content):
    return F.regexp_extract(content, r"(?s)## Conflicts\n(.*)\z", 1)


def carry_forward(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """Fresh pages with what people have set on the old ones: a confidence over draft, conflicts that aren't the placeholder."""
    rows = fresh.join(old.select("path", F.col("content").alias("was")), "path", "left")
    level = confidence_of(F.col("was"))
    text = F.when(F.col("was").isNotNull() & (level != "draft"), F.regexp_replace("content", r"(?m)^confidence: draft$", F.concat(F.lit("confidence: "), level))).otherwise(F.col("content"))
    notes = conflicts_of(F.col("was"))
    kept = F.col("was").isNotNull() & ~F.trim(notes).isin("", "- none")
    head = F.regexp_replace(text, r"(?s)## Conflicts\n.*\z", "")
    return rows.select("path", F.when(kept, F.concat(head, F.lit("## Conflicts\n"), notes)).otherwise(text).alias("content"))


def promote(pages: DataFrame, verified: DataFrame) -> DataFrame:
    """Pages one rung up the ladder where a verification (path) stands."""
    rows = pages.join(verified.select("path", F.lit(True).alias("ok")).distinct(), "path", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    level = X.next_rung(confidence_of(F.col("content")), "ok")
    return rows.select("path", F.regexp_replace("content", r"(?m)^confidence: \w+$", F.concat(F.lit("confidence: "), level)).alias("content"))


def source_questions(sections: DataFrame, limit: int = 5) -> DataFrame:
    """doc_path, questions: the first section titles of a document that aren't technical, as questions."""
    rows = sections.filter(~F.col("title").rlike(r"^(__|p\.)") & (F.trim("title") != ""))
    w = Window.partitionBy("doc_path").orderBy("ordinal", "id")
    top = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    return top.groupBy("doc_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: F.concat(F.lit("What about "), x["title"], F.lit("?"))).alias("questions"))


def retire_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Paths of source pages whose document (path) is gone."""
    origin = F.regexp_replace(F.regexp_replace("path", "^sources/", ""), r"\.md$", "")
    return pages.filter(F.col("path").startswith("sources/")).withColumn("origin", origin).join(documents.select(F.col("path").alias("origin")), "origin", "left_anti").select("path")


def faq(questions: DataFrame, evidence: DataFrame, cites: int = 3) -> DataFrame:
    """qid, entry: a question with the first evidence (qid, rank, id, raw) as its answer and its citations."""
    top = evidence.filter(F.col("rank") < cites).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "raw"))).alias("e"))
    body = F.concat(F.lit("## "), "question", F.lit("\n"), F.substring(F.col("e")[0]["raw"], 1, 180), F.lit("\n"), F.array_join(F.transform("e", lambda x: F.concat(F.lit("[["), x["id"], F.lit("]]"))), " "))
    return questions.join(top, "qid").select("qid", body.alias("entry"))


def answer_pages(answers: DataFrame, links: int = 8) -> DataFrame:
    """path, content of draft pages of (question, answer, evidence ids)."""
    content = F.concat(F.lit("---\nconfidence: draft\n---\n# "), "question", F.lit("\n\n"), "answer", F.lit("\n\n## Evidence\n"), bullets(F.slice("evidence", 1, links), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), F.lit("\n"))
    return answers.select(F.concat(F.lit("answers/"), X.slug("question"), F.lit(".md")).alias("path"), content.alias("content"))


def synthesis_pages(entities_: DataFrame, limit: int = 10, sources: int = 3) -> DataFrame:
    """topic, content: the entities (topic, entity_id, n_facts, doc_path) with most facts and the first sources."""
    w = Window.partitionBy("topic").orderBy(F.desc("n_facts"), "entity_id")
    top = entities_.groupBy("topic", "entity_id").agg(F.sum("n_facts").alias("n_facts")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    names = top.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entity_id"))), lambda x: x["entity_id"]).alias("names"))
    docs = entities_.select("topic", "doc_path").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy("doc_path"))).filter(F.col("rn") <= sources).groupBy("topic").agg(F.array_sort(F.collect_list("doc_path")).alias("docs"))
    content = F.concat(F.lit("# "), "topic", F.lit("\n"), bullets(F.col("names"), lambda x: F.concat(F.lit("- [[entities/"), x, F.lit("]]"))), F.lit("\nsources: "), F.array_join("docs", ", "))
    return names.join(docs, "topic").select("topic", content.alias("content"))
