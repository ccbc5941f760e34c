"""Prefix trie of conversations: nodes with members, children, leaves and what sharing their turns saves.

A node is a distinct sequence of first turns (role, text).  Subtree sums are rolled up by bands of depth: inside a band a
node explodes only to its ancestors of that band, then completed totals of the bands' roots go up band by band.  With
bands of height H and a greatest depth D the explosion is at most H rows a node and the rounds are D / H."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import discard, enter, materialize

#: Conversations per family: each takes its first turns from the one whose id is the multiple at or below it (towards zero).
FAMILY = 100
#: Remainders of the id's checksum: the number of turns taken from the family's first conversation.
TAKEN = 6
#: Least height of a band; the square root of the greatest depth where that is more.
BAND = 32
NODE = ["d", "i1", "i2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _numbered(batches):
    """Rows sorted by conversation with the number of the task and their place in their conversation's run there."""
    enter("trie")
    part, last, so_far = TaskContext.get().partitionId(), None, 0
    for b in batches:
        conv = b.column("conv_id").to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        sizes = np.diff(np.r_[starts, len(conv)])
        at = np.arange(len(conv)) - np.repeat(starts, sizes)
        if conv[0] == last:
            at[: sizes[0]] += so_far
        last, so_far = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "k1", "k2", "size")), pa.array(np.full(len(conv), part, dtype=np.int32)), pa.array(at.astype(np.int64))], names=["conv_id", "k1", "k2", "size", "part", "at"])


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (hashes of role and text), size (code points of the text), by turn, null first.

    Rows of one turn: by role, then by the first 32 characters and the hash of their text.  Rows without a conv_id go.
    The texts stay where they are; rows are dealt by range, so a conversation of any length is spread over tasks, and its
    runs are joined by one row a task."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 32).alias("tie"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(7), text, role).alias("k2"), F.length(text).cast("bigint").alias("size"))
    order = ["conv_id", "turn", "role", "tie", "k1", "k2"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialize(dealt.mapInArrow(_numbered, "conv_id bigint, k1 bigint, k2 bigint, size bigint, part int, at bigint"), "trie-runs")
    ends = runs.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()  # a row a task
    before: dict[int, int] = {}
    shifts = []
    for e in ends:
        if before.get(e.first):
            shifts.append((e.part, e.first, before[e.first]))
        before = {e.last.conv_id: e.last.at + 1 + (before.get(e.last.conv_id, 0) if e.first == e.last.conv_id else 0)}
    shift = conversations.sparkSession.createDataFrame(shifts, "part int, conv_id bigint, shift bigint")
    out = runs.join(F.broadcast(shift), ["part", "conv_id"], "left").select("conv_id", (F.col("at") + 1 + F.coalesce("shift", F.lit(0))).alias("pos"), "k1", "k2", "size")
    out._own_folder = runs._own_folder
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lengths (c, depth) of all conversations and turns (c, d from 1, k1, k2, size, depth) as the contract rebuilds them."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % TAKEN
    own = turns.groupBy(F.col("conv_id").alias("c")).agg(F.max("pos").alias("n")).select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("family"))
    own = materialize(own, "trie-own")
    head = own.filter(F.col("c") == F.col("family")).select("family", F.col("n").alias("there"))  # a family has at most 2 * FAMILY members
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = materialize(own.join(head, "family", "left").select("c", "family", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")), "trie-lengths")
    discard(own)
    keys = ["c", "d", "k1", "k2", "size", "depth"]
    kept = turns.withColumnRenamed("conv_id", "c").join(convs, "c").filter("pos > h").withColumn("d", F.col("taken") + F.col("pos") - F.col("h")).select(keys)
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < TAKEN)).withColumnRenamed("conv_id", "family")
    shared = heads.join(convs.filter("taken > 0"), "family").filter("pos <= taken").withColumn("d", F.col("pos")).select(keys)
    return convs, kept.unionByName(shared)


def paths(turns: DataFrame, height: int, deepest: int) -> DataFrame:
    """c, d, band, i1, i2 (node), p1, p2 (its parent), size, ends: every conversation's nodes, the root left out.

    A node's name is the exclusive or of its turns' hashes, each mixed with its depth: two hashes of 64 bits.  It is
    summed inside a band first; what lies in the bands before is added to that, at most D / H + 1 rows a conversation."""
    rows = turns.select("c", "d", F.floor(F.col("d") / height).cast("int").alias("band"), F.xxhash64("k1", "k2", "d").alias("m1"), F.xxhash64("d", "k2", "k1").alias("m2"), "size", (F.col("d") == F.col("depth")).alias("ends"))
    inside = Window.partitionBy("c", "band").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"i1": F.bit_xor("m1").over(inside), "i2": F.bit_xor("m2").over(inside)})
    if deepest >= height:
        up_to = Window.partitionBy("c").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        bands = rows.groupBy("c", "band").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
        carry = bands.select("c", "band", F.bit_xor("m1").over(up_to).alias("c1"), F.bit_xor("m2").over(up_to).alias("c2")).filter("band > 0")
        local = local.join(carry, ["c", "band"], "left").withColumns({f"i{k}": F.col(f"i{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in (1, 2)})
    return local.select("c", "d", "band", "i1", "i2", F.col("i1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("i2").bitwiseXOR(F.col("m2")).alias("p2"), "size", "ends")


def _hashed(batches):
    """ends_sha256 of each node from its ids' text, piece after piece; rows are sorted by node and piece."""
    enter("trie")
    node, state = None, None
    row = lambda: {"d": node[0], "i1": node[1], "i2": node[2], "ends_sha256": state.hexdigest()}
    schema = pa.schema([("d", pa.int64()), ("i1", pa.int64()), ("i2", pa.int64()), ("ends_sha256", pa.string())])
    for b in batches:
        out = []
        for d, i1, i2, ids in zip(*(b.column(c).to_pylist() for c in ("d", "i1", "i2", "ids"))):
            if (d, i1, i2) != node:
                if node:
                    out.append(row())
                node, state = (d, i1, i2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if node:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def digests(ends: DataFrame) -> DataFrame:
    """d, i1, i2, ends_sha256 of the ids (c) that end at each node, ascending and joined by commas.

    Ids are gathered in pieces of 65,536 consecutive numbers each; the pieces of a node then stream through one hash, as
    no such hash can be taken in parts: one task reads the text of a node's ids, piece by piece."""
    piece = F.shiftright("c", 16)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*NODE, piece.alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(_hashed, "d bigint, i1 bigint, i2 bigint, ends_sha256 string")


def rolled_up(rows: DataFrame, nodes: DataFrame, height: int, deepest: int) -> DataFrame:
    """d, i1, i2, saved, leaves: sums of `saved` and `leaf` of `nodes` (with c, a member whose path leads there) over all
    subtrees but the root's.

    The nodes of one member in one band are a chain: their values are added from the deepest on and sent to the chain's
    ancestors in the band, at most `height` rows.  A band's root takes part in its own band; its completed total then goes
    to the ancestors in the band above."""
    chain = rows.join(nodes.select("c", "d", "saved", "leaf"), ["c", "d"], "left")
    below = Window.partitionBy("c", "band").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    sums = chain.select(*NODE, F.count("leaf").over(below).alias("own"), F.sum("saved").over(below).alias("saved"), F.sum("leaf").over(below).alias("leaves")).filter("own > 0")
    inside = sums.groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    if deepest < height:
        return inside
    inside = materialize(inside, "trie-bands")
    at_root = rows.filter(F.col("d") % height == 0).select("c", "d", "i1", "i2")
    over = at_root.select("c", (F.col("d") + height).alias("d"), F.col("i1").alias("u1"), F.col("i2").alias("u2"))
    roots = nodes.filter((F.col("d") % height == 0) & (F.col("d") > 0)).select("c", *NODE).join(inside, NODE).join(over, ["c", "d"], "left")
    roots = materialize(roots.withColumn("band", (F.col("d") / height).cast("int")), "trie-roots")
    done, above = [], None
    for band in range(deepest // height, 0, -1):
        now = roots.filter(F.col("band") == band)
        if above is not None:
            came = above.groupBy(F.col("u1").alias("i1"), F.col("u2").alias("i2")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
            now = now.join(came, ["i1", "i2"], "left").withColumns({"saved": F.col("saved") + F.coalesce("more", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0))}).select(roots.columns)
        above = materialize(now, "trie-totals")
        done.append(above)
    totals = done[0]
    for t in done[1:]:
        totals = totals.unionByName(t)
    upper = rows.select("c", "band", *NODE).join(totals.select("c", (F.col("band") - 1).alias("band"), "saved", "leaves"), ["c", "band"])
    out = materialize(inside.unionByName(upper.select(*NODE, "saved", "leaves")).groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-sums")
    discard(inside, roots, *done)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    `conversations` has conv_id, turn, role and text; other columns are ignored, whatever their names.  Null roles and
    texts are empty, rows without a conv_id go, repeated rows are turns of their own, turns of equal number are ordered as
    `positions` says.  A conversation may come to have no turn; it is then a member of the root alone.  No rows: no nodes,
    not even a root.  Texts of any length are hashed where they lie."""
    turns = positions(conversations)
    convs, taken = rebuilt(turns)
    about = convs.agg(F.count("*").alias("n"), F.min("c").alias("c"), F.max("depth").alias("deepest")).first()
    deepest = int(about.deepest or 0)
    height = max(BAND, math.isqrt(deepest) + 1)
    rows = materialize(paths(taken, height, deepest), "trie-paths")
    discard(turns)
    seen = materialize(rows.groupBy(*NODE).agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("size").alias("size")), "trie-seen")
    root = conversations.sparkSession.createDataFrame([(0, 0, 0, about.c, about.n, None, None, 0)] if about.n else [], "d bigint, i1 bigint, i2 bigint, c bigint, n_convs bigint, p1 bigint, p2 bigint, size bigint")
    under = seen.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("i1"), F.col("p2").alias("i2")).agg(F.count("*").alias("n_children"))
    nodes = seen.unionByName(root).join(under, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("size"), "leaf": (F.col("n_children") == 0).cast("bigint")}), "trie-nodes")
    discard(seen)
    sums = rolled_up(rows, nodes, height, deepest)
    whole = nodes.filter("d > 0 or leaf = 1").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")).select(*(F.lit(0).cast("bigint").alias(c) for c in NODE), "saved", "leaves")
    ends = digests(rows.filter("ends").select(*NODE, "c").unionByName(convs.filter("depth = 0").select(*(F.lit(0).cast("bigint").alias(c) for c in NODE), "c")))
    # the root's children know their parent; the others look it up
    up = nodes.select((F.col("d") + 1).alias("d"), F.col("i1").alias("p1"), F.col("i2").alias("p2"), F.col("c").alias("parent"))
    deep = nodes.filter("d > 1").join(up, ["d", "p1", "p2"], "left")
    top = nodes.filter("d <= 1").withColumn("parent", F.when(F.col("d") == 1, F.lit(about.c)).cast("bigint"))
    out = deep.unionByName(top.select(deep.columns)).join(sums.unionByName(whole).toDF(*NODE, "saved_tokens", "n_leaves"), NODE, "left").join(ends, NODE, "left")
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
