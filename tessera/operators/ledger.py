"""Verdicts on blocks as a versioned table: recorded first, replayed on every state of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.operators import lifecycle
from tessera.session import stored
from tessera.sources.registry import Entry, Registry, Snapshot, Superseded

#: The form of the ledger; one of another number is an error.
VERSION = 1
PARTS = 64


def verdicts(snapshot: Snapshot) -> DataFrame:
    """id, state, reason, content_hash, updated of all blocks with a verdict."""
    if not snapshot.has("ledger"):
        return snapshot.spark.createDataFrame([], "id string, state string, reason string, content_hash string, updated string")
    if snapshot.entries["ledger"].facts.get("version") != VERSION:
        raise ValueError(f"ledger of version {snapshot.entries['ledger'].facts.get('version')}; this is {VERSION}")
    return snapshot.table("ledger")


def decide(registry: Registry, asked: DataFrame, blocks: DataFrame, tries: int = 5) -> Snapshot:
    """Records verdicts (id, state, reason, updated) with the hash of what the block says now; returns the version.

    A verdict on a block that isn't there, or of an unknown state, is an error and nothing is recorded.  Of several on one
    block the last (by `updated`, then state and reason) counts.  Only the parts that hold a block of `asked` are
    written, and only if no other writer was first; else the verdicts are put on top of what that one wrote."""
    last = asked.groupBy("id").agg(F.max(F.struct("updated", "state", "reason")).alias("v")).select("id", "v.state", "v.reason", "v.updated")
    rows = stored(last.join(blocks.select("id", F.col("hash").alias("content_hash")), "id", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")))
    bad = rows.filter(F.col("content_hash").isNull() | ~F.coalesce(F.col("state").isin(*S.STATES), F.lit(False))).select("id", "state").limit(1).collect()
    if bad:
        raise ValueError(f"no such block, or no such state: {bad[0].id} {bad[0].state}")
    touched = [str(r.part) for r in rows.select("part").distinct().collect()]  # at most PARTS numbers
    for _ in range(tries):
        now = registry.snapshot()
        verdicts(now)  # the version is right
        columns = ["id", "state", "reason", "content_hash", "updated"]
        kept = now.table("ledger", touched).join(rows.select("id"), "id", "left_anti").select(columns) if now.has("ledger") else rows.limit(0).select(columns)
        made = registry.write(kept.unionByName(rows.select(columns)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).hint("rebalance", "part"), "part")
        old = now.entries["ledger"].parts if now.has("ledger") else {}
        try:
            return registry.publish(now, {"ledger": Entry(old | made.parts, made.schema, "", {"version": VERSION})})
        except Superseded:
            continue
    raise Superseded(f"{tries} other writers were first")


def replay(snapshot: Snapshot, blocks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """states (id, state, reason) and stale pages (page, reason, n) of a corpus as it is now.

    A verdict holds for the words that were judged: where a block's hash is another now, or the block is gone, it does not
    apply.  Every page (page, text) that cites a block with a verdict is stale again; its reason is that of the first
    such block by id, n the number of them."""
    states = verdicts(snapshot).join(blocks.select("id", F.col("hash").alias("content_hash")), ["id", "content_hash"]).select("id", "state", "reason")
    cited = lifecycle.citations(pages).join(states, "id")
    why = F.concat_ws(" ", F.lit("cited"), "state", F.concat("id", F.lit(":")), "reason")
    return states, cited.groupBy("page").agg(F.min_by(why, "id").alias("reason"), F.count_distinct("id").alias("n"))
