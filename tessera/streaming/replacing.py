"""Ingest that replaces: a feed of document changes is merged into stored blocks, by document, batch after batch.

A change is a document as it now is, or its deletion, with a number that grows (`seq`).  Of all changes to a document the
highest number counts, whatever the order and however often they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import lifecycle
from tessera.operators.ingest import line_blocks
from tessera.sources.registry import Entry, Registry, Snapshot, Superseded

CHANGE = "doc_id bigint, text string, lang string, source string, seq bigint, deleted boolean"
#: Characters of text that one part should hold; the number of parts is set by the first batch, for four of its size.
PART_CHARS = 64_000_000


def _parts(before: Snapshot, changes: DataFrame) -> int:
    if before.has("documents"):
        return before.entries["documents"].facts["parts"]
    chars = changes.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return max(8, min(8192, -(-4 * chars // PART_CHARS)))


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")


def newest(changes: DataFrame) -> DataFrame:
    """One row a document: the change of the highest number, a deletion before a text, equal ones once.

    The number is found by partial aggregates, so a document that a third of the feed is about doesn't meet in one task."""
    order = F.struct("seq", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.xxhash64("text", "lang", "source").alias("mark"))
    rows = changes.filter("doc_id is not null and seq is not null").withColumn("order", order)
    best = rows.groupBy("doc_id").agg(F.max("order").alias("order"))
    first = {c: F.first(c).alias(c) for c in ("text", "lang", "source")}
    return rows.join(best, ["doc_id", "order"]).groupBy("doc_id", "order").agg(*first.values()).select("doc_id", "text", "lang", "source", F.col("order.seq").alias("seq"), F.col("order.deleted").alias("deleted"))


def merge(registry: Registry, changes: DataFrame, batch: int | None = None, feed: str = "feed", blocks_of: Callable[[DataFrame], DataFrame] = line_blocks, parts: int | None = None, tries: int = 5) -> Snapshot:
    """Publishes the version of `documents`, `blocks` and `changes` that follows from a batch of changes.

    Blocks of changed documents are replaced, those of deleted ones go and leave a tombstone (a row of `documents` with
    its number), so a late change with a lower number doesn't bring them back.  Only the parts (by the hash of doc_id)
    that hold a changed document are read and written.  A batch of a feed that a version has applied is not applied again.
    `changes` (doc_id, doc_path, change) says what the batch did: added, changed or deleted; a document whose blocks stay as
    they were is not in it.  The number of parts is set by the first batch.  Rows without doc_id or number are ignored; null texts have no blocks."""
    for _ in range(tries):
        before = registry.snapshot()
        if batch is not None and int(before.marks.get(feed, "-1")) >= batch:
            return before
        parts = parts or _parts(before, changes)
        staged = registry.write(newest(changes).withColumn("part", _part(parts)))
        new = Snapshot(registry.spark, 0, {"new": staged}).table("new")
        touched = [str(r.part) for r in new.select("part").distinct().collect()]  # at most `parts` numbers
        if before.has("documents"):
            known, stored = before.table("documents", touched), before.table("blocks", touched)
        else:
            known, stored = new.limit(0).select("doc_id", F.lit("").alias("doc_path"), "seq", "deleted", F.lit("").alias("fp")), None
        known = known.select("doc_id", *(F.col(c).alias(f"old_{c}") for c in ("doc_path", "seq", "deleted", "fp")))
        fresh = new.join(known, "doc_id", "left").filter("old_seq is null or seq > old_seq")
        made = blocks_of(fresh.filter("not deleted").select("doc_id", "text", "lang", "source"))
        if "hash" not in made.columns:
            made = made.withColumn("hash", lifecycle.X.content_hash("raw"))
        written = registry.write(made.withColumn("part", _part(parts)).hint("rebalance", "part"), "part")
        made = Snapshot(registry.spark, 0, {"made": written}).table("made")
        paths = made.groupBy("doc_id").agg(F.first("doc_path").alias("new_path"))
        marks = lifecycle.fingerprints(made, "doc_id", "raw").withColumnRenamed("doc", "doc_id").join(paths, "doc_id")
        docs = fresh.join(marks, "doc_id", "left").withColumn("doc_path", F.coalesce("new_path", "old_doc_path"))
        state = docs.select("doc_id", "doc_path", "seq", "deleted", F.coalesce("fp", F.lit("")).alias("fp"))
        gone = F.coalesce("old_deleted", F.lit(True))
        kind = F.when(F.col("deleted"), F.when(~gone, "deleted")).when(gone, "added").when(F.coalesce("fp", F.lit("")) != F.col("old_fp"), "changed")
        entries = {"changes": registry.write(docs.select("doc_id", "doc_path", kind.alias("change")).filter("change is not null"))}
        old_docs = before.table("documents", touched).join(fresh.select("doc_id"), "doc_id", "left_anti") if before.has("documents") else state.limit(0)
        entries["documents"] = registry.write(old_docs.unionByName(state).withColumn("part", _part(parts)).hint("rebalance", "part"), "part")
        if stored is not None:
            kept = stored.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(made)
            entries["blocks"] = registry.write(kept.withColumn("part", _part(parts)).hint("rebalance", "part"), "part")
        else:
            entries["blocks"] = written
        for name in ("documents", "blocks"):
            old = before.entries[name].parts if before.has(name) else {}
            entries[name] = Entry({k: v for k, v in old.items() if k not in touched} | entries[name].parts, entries[name].schema, "", {"parts": parts})
        try:
            return registry.publish(before, entries, marks={feed: str(batch)} if batch is not None else None)
        except Superseded:
            continue  # another writer was first: once more, from what it has published
    raise Superseded(f"{tries} other writers were first")


def follow(spark: SparkSession, feed: str, root: str, state: str, files_per_batch: int = 1000, after: Callable[[Snapshot], None] | None = None, blocks_of: Callable[[DataFrame], DataFrame] = line_blocks) -> StreamingQuery:
    """A stream over the change files of a folder that merges every batch into the registry at `root`; `state` remembers
    the files.  `after` sees each version.  Takes what is there now and ends; a restart goes on from there, and a batch
    that is given again after a failure is not applied twice."""

    def apply(batch: DataFrame, number: int) -> None:
        made = merge(Registry(batch.sparkSession, root), batch, number, blocks_of=blocks_of)
        if after:
            after(made)

    changes = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(feed)
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
