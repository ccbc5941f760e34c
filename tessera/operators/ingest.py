"""From documents to sections and blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X


def walk(spark: SparkSession, path: str, layer: str = "raw") -> DataFrame:
    """path, text, layer of the Markdown files below a folder, hidden index folders left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").text(path, wholetext=True)
    root = path.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.input_file_name(), rf"^.*?{root}/", "")
    return files.select(F.url_decode(rel).alias("path"), F.col("value").alias("text"), F.lit(layer).alias("layer")).filter(~F.col("path").rlike(r"(^|/)\.(index|git)/"))


def supported(path):
    """Whether the extension is one that the engine reads."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("md", "markdown", "pdf")


def frontmatter(text):
    """The text between the first two lines of three hyphens, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1), F.lit(""))


def body(text):
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")


def frontmatter_map(text):
    """Keys to lists of values: `k: v` is one value, `k: [a, b]` several; quotes are stripped."""
    lines = F.filter(F.split(F.coalesce(frontmatter(text), F.lit("")), "\n"), lambda s: s.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    strip = lambda s: F.regexp_replace(F.trim(s), r"^[\"']|[\"']$", "")

    def values(s):
        v = F.trim(F.regexp_replace(s, r"^[^:]*:", ""))
        many = F.filter(F.transform(F.split(F.regexp_replace(v, r"^\[|\]$", ""), ","), strip), lambda x: x != "")
        return F.when(v.startswith("["), many).otherwise(F.array(strip(v)))

    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^:]*):", 1)).alias("k"), values(s).alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


#: What is white space at the ends of a line.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def fold_document(path: str, text: str, first: int = 0) -> tuple[list[tuple], list[tuple]]:
    """Sections (id, parent_id, title, summary, ordinal) and blocks (id, section_id, trail, raw, ordinal) of one body.

    One walk over the lines; the state is the open headings, so the time is linear in the text.  A later heading of the same
    path takes the place of an earlier one, and so do blocks of the same id."""
    open_, names, trail, pending = [], [], "", []  # names: the ids' trails of the open headings
    sections: dict[str, list] = {}
    blocks: dict[str, tuple] = {}
    number, heads = first, 0

    def close():
        nonlocal number
        if pending:
            at = f"{path}#{trail}" if names else path
            blocks[f"{at}/{number}"] = (f"{at}/{number}", at if names else None, trail if names else None, "\n".join(pending), number)
            number += 1
            pending.clear()

    for line in text.split("\n"):
        line = line.strip(BLANK)
        if line.startswith("#"):
            close()
            title = line.lstrip("#")
            level = min(len(line) - len(title), 6)
            title = title.strip(BLANK)
            while open_ and open_[-1] >= level:
                open_.pop()
                names.pop()
            parent = f"{path}#{names[-1]}" if names else None
            trail = f"{names[-1]}/{title}" if names else title
            open_.append(level)
            names.append(trail)
            sections[f"{path}#{trail}"] = [f"{path}#{trail}", parent, title, "", heads]
            heads, number = heads + 1, first
        elif line:
            pending.append(line)
        else:
            close()
    close()
    for s in sections.values():
        one = blocks.get(f"{s[0]}/{first}")
        s[3] = one[3].replace("\n", " ")[:160] if one else ""
    return [tuple(s) for s in sections.values()], list(blocks.values())


def _folded(docs: DataFrame, first: int) -> DataFrame:
    """path, layer, title, kind, id, up (parent or section), name (title or trail), value (summary or text), ordinal."""
    names = ["path", "layer", "title", "kind", "id", "up", "name", "value", "ordinal"]
    text = F.coalesce("text", F.lit(""))
    title = F.coalesce(F.nullif(F.get(frontmatter_map(text)["title"], F.lit(0)), F.lit("")), F.col("path"))
    rows = docs.select("path", "layer", title.alias("title"), body(text).alias("body"))

    def run(batches):
        for b in batches:
            for path, layer, title, text in zip(*(b.column(c).to_pylist() for c in ("path", "layer", "title", "body"))):
                sections, blocks = fold_document(path or "", text, first)
                out = [(path, layer, title, kind, *row) for kind, rows in (("section", sections), ("block", blocks)) for row in rows]
                for lo in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "ordinal" else pa.string()) for n, c in zip(names, zip(*out[lo : lo + 10_000]))], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} {'int' if n == 'ordinal' else 'string'}" for n in names))


def parse(docs: DataFrame, first: int = 0, titled: bool = False) -> tuple[DataFrame, DataFrame]:
    """sections (id, doc_path, parent_id, title, summary, ordinal, layer) and blocks (id, doc_path, section_id, type,
    breadcrumb, raw, hash, ordinal, layer) of Markdown documents (path, text, layer).

    The path of a heading is the last heading of each lower level that no heading of an equal or lower level follows.
    `first` is the number of a section's first block; with `titled`, breadcrumbs begin with the document's title and
    blocks before any heading belong to the document as their section.  A document is one row and is walked once; null
    texts have no rows."""
    rows = _folded(docs, first)
    sections = rows.filter("kind = 'section'").select("id", F.col("path").alias("doc_path"), F.col("up").alias("parent_id"), F.col("name").alias("title"), F.col("value").alias("summary"), "ordinal", "layer")
    crumb = F.coalesce(F.regexp_replace("name", "/", " > "), F.lit(""))
    section = F.col("up")
    if titled:
        crumb = F.concat_ws(" > ", "title", F.nullif(crumb, F.lit("")))
        section = F.coalesce(section, F.col("path"))
    blocks = rows.filter("kind = 'block'").withColumn("crumb", crumb)
    return sections, blocks.select("id", F.col("path").alias("doc_path"), section.alias("section_id"), X.block_type("value").alias("type"), F.col("crumb").alias("breadcrumb"), F.col("value").alias("raw"), X.content_hash(F.concat("crumb", F.lit("\n"), F.col("value"))).alias("hash"), "ordinal", "layer")


def line_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of the `documents` table: a line is a block, its source the section.  Narrow: no shuffle."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    layer = F.when(F.col("doc_id") % 5 == 0, "wiki").otherwise("raw")
    rows = documents.select("doc_id", "lang", path.alias("doc_path"), F.col("source").alias("breadcrumb"), layer.alias("layer"), F.posexplode(parts).alias("ordinal", "raw"))
    section = F.concat("doc_path", F.lit("#"), "breadcrumb")
    return rows.select(F.concat(section, F.lit("/"), "ordinal").alias("id"), "doc_id", "lang", "doc_path", section.alias("section_id"), "breadcrumb", "raw", "ordinal", "layer")


def pages_to_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of page texts (path, page, text): the first short line without an end mark heads the page unless it is the
    last; the other lines, joined by spaces, are one block.  Pages without text give none."""
    ls = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    first = F.element_at(ls, 1)
    headed = (F.size(ls) > 1) & (F.length(first) <= 60) & ~first.rlike(r"[。！？；，,.!?;:：]$")
    rows = pages.withColumn("ls", ls).filter(F.size("ls") > 0).withColumn("title", F.when(headed, first).otherwise(F.lit("")))
    raw = F.array_join(F.when(headed, F.slice("ls", 2, F.size("ls") - 1)).otherwise(F.col("ls")), " ")
    return rows.select(F.concat("path", F.lit("#p"), "page", F.lit("/0")).alias("id"), F.col("path").alias("doc_path"), F.concat("path", F.lit("#p"), "page").alias("section_id"), "title", raw.alias("raw"), F.array("page", "page").alias("page_range"), F.when(raw.contains("|"), "table").otherwise("paragraph").alias("type"))


def looks_scanned(pages: DataFrame, least: int = 40) -> DataFrame:
    """Per path, whether fewer than half the pages (one at least) hold `least` characters."""
    return pages.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) >= least).alias("usable")).select("path", (F.col("usable") < F.greatest(F.lit(1), F.floor(F.col("n") / 2))).alias("scanned"))
