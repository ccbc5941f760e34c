"""Change, deletion, retraction and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


def fingerprints(blocks: DataFrame, key: str = "doc_path", content: str = "raw") -> DataFrame:
    """doc, fp: a hash of the block hashes of a document in their order."""
    h = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", X.content_hash(content).alias("h")))), lambda x: x["h"])
    return blocks.groupBy(F.col(key).alias("doc")).agg(F.sha2(F.array_join(h, "|").cast("binary"), 256).alias("fp"))


def diff_docs(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, change (added, changed, deleted) of two fingerprint tables."""
    both = before.select("doc", F.col("fp").alias("a")).join(after.select("doc", F.col("fp").alias("b")), "doc", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return both.select("doc", change.alias("change")).filter("change is not null")


def citations(pages: DataFrame) -> DataFrame:
    """page, id of the blocks that page texts cite: extracted and matched by equality, not searched for."""
    return pages.select("page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))).alias("id"))


def retract(retracted: DataFrame, pages: DataFrame) -> DataFrame:
    """page, stale for every page that cites a retracted block (id)."""
    return citations(pages).join(retracted.select("id").distinct(), "id", "left_semi").select("page", F.lit(True).alias("stale")).distinct()


def replay_ledger(ledger: DataFrame, blocks: DataFrame) -> DataFrame:
    """id, state of the verdicts whose content hash is still that of the block."""
    return ledger.join(blocks.select("id", F.col("hash").alias("content_hash")), ["id", "content_hash"]).select("id", "state")


def stale_pages(changes: DataFrame, page_sources: DataFrame) -> DataFrame:
    """Pages that cite a changed or deleted document (page, doc)."""
    return page_sources.join(changes.filter("change <> 'added'").select("doc"), "doc", "left_semi").select("page").distinct()


def vector_delta(blocks: DataFrame, encoded: DataFrame) -> DataFrame:
    """id, action: encode what is new or has another hash, drop what is gone."""
    both = blocks.select("id", F.col("hash").alias("a")).join(encoded.select("id", F.col("hash").alias("b")), "id", "full")
    action = F.when(F.col("a").isNull(), "drop").when(F.col("b").isNull() | (F.col("a") != F.col("b")), "encode")
    return both.select("id", action.alias("action")).filter("action is not null")


def vector_coverage(blocks: DataFrame, encoded: DataFrame) -> DataFrame:
    """embeddable, encoded, pending: blocks with text, those of them that have a vector (id), and the rest."""
    rows = blocks.filter(F.length(F.regexp_replace("raw", X.SPACE, "")) > 0).select("id").join(encoded.select("id", F.lit(1).alias("has")).distinct(), "id", "left")
    return rows.agg(F.count("*").alias("embeddable"), F.count("has").alias("encoded"), F.count_if(F.col("has").isNull()).alias("pending"))


def mark_stale(pages: DataFrame, marks: DataFrame, clear: bool = False) -> DataFrame:
    """doc_path, state, stale, reason of all pages (doc_path, state, stale, reason) after marks (page, reason), by name.

    Staleness and state are apart: a mark never changes the state that a person set, and a page without a row is active.
    Keys are those of `text.page_key`, so a page is the same under any of its names; of several marks the first by reason
    counts.  `clear` takes the flag away instead."""
    new = marks.select(X.page_key("page").alias("doc_path"), F.col("reason").alias("why")).groupBy("doc_path").agg(F.min("why").alias("why"), F.lit(True).alias("met"))
    rows = pages.select(X.page_key("doc_path").alias("doc_path"), "state", "stale", "reason").join(new, "doc_path", "full")
    met = F.coalesce("met", F.lit(False))
    out = rows.select("doc_path", F.coalesce("state", F.lit("active")).alias("state"), F.when(met, F.lit(not clear)).otherwise(F.coalesce("stale", F.lit(False))).alias("stale"), F.when(met, F.col("why")).otherwise(F.col("reason")).alias("reason"))
    return out.orderBy("doc_path")


def declared_states(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """id, state of the blocks of documents (path, state) that declare one other than active, and of the pages made from
    them (`sources/` and the path); a document without one leaves nothing behind."""
    said = documents.filter("state is not null and state <> 'active'").select("path", "state")
    keys = said.select(F.explode(F.array(F.col("path"), F.concat(F.lit("sources/"), "path"))).alias("doc_path"), "state")
    return blocks.select("id", "doc_path").join(keys, "doc_path").select("id", "state")


def corpus_stamp(df: DataFrame, *cols: str) -> DataFrame:
    """n, stamp: one digest that changes with any row, whatever the order of rows.

    A row's values are written with their lengths, so no two rows look alike; halves of its digest are summed, which tasks
    do on their own, and the sums are digested once more."""
    value = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    digest = F.md5(F.concat(*map(value, cols)).cast("binary"))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    rows = df.agg(F.count("*").alias("n"), half(1).alias("low"), half(18).alias("high"))
    return rows.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "low", "high").cast("binary"), 256).alias("stamp"))


def purge(rows: DataFrame, deleted: DataFrame, key: str = "doc_path") -> DataFrame:
    """Rows of documents that still exist; pages made from deleted ones go with them."""
    gone = deleted.select(F.col("doc").alias(key)).unionByName(deleted.select(F.concat(F.lit("sources/"), "doc").alias(key)))
    return rows.join(gone, key, "left_anti")
