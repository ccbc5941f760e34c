"""Neighbours inside groups of any size: rows dealt by range, chains stitched where tasks meet."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored


def successors(rows: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, next: each row of (group, item) with the item after it in its group; the last of a group has none.

    What `lead` over a window by group gives, but a group of any size is spread over tasks: rows are dealt by ranges of
    (group, item), a task links its own, and of each task the first and the last row (two a task) tell how chains go on
    in the next.  Nulls come first; a null group is a group.  Equal rows follow one another."""
    dealt = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).repartitionByRange("g", "i").sortWithinPartitions("g", "i")
    g_type, i_type = (rows.schema[c].dataType.simpleString() for c in (group, item))

    def link(batches):
        part, held = TaskContext.get().partitionId(), None

        def out(g, i, nxt, kind):
            n = len(g)
            return pa.RecordBatch.from_arrays([g, i, nxt, pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32())], names=["g", "i", "next", "part", "kind"])

        for b in batches:
            if not b.num_rows:
                continue
            g, i = b.column("g"), b.column("i")
            if held is None:
                yield out(g.slice(0, 1), i.slice(0, 1), pa.nulls(1, i.type), 1)  # the first of the task
            else:
                g, i = (pa.concat_arrays([h, c]) for h, c in zip(held, (g, i)))
            a, z = g.slice(0, len(g) - 1), g.slice(1)
            same = pc.fill_null(pc.or_(pc.equal(a, z), pc.and_(pc.is_null(a), pc.is_null(z))), False)
            same = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(z)), True, same)
            if len(a):
                yield out(a, i.slice(0, len(i) - 1), pc.if_else(same, i.slice(1), pa.nulls(len(a), i.type)), 0)
            held = (g.slice(len(g) - 1), i.slice(len(i) - 1))
        if held is not None:
            yield out(*held, pa.nulls(1, held[1].type), 2)  # the last of the task: its successor is not known yet

    linked = stored(dealt.mapInArrow(link, f"g {g_type}, i {i_type}, next {i_type}, part int, kind int"), "chains")
    ends = {}
    for r in linked.filter("kind > 0").collect():  # two rows a task
        ends.setdefault(r.part, {})[r.kind] = r
    order = sorted(ends)
    stitched = []
    for part, after in zip(order, [*order[1:], None]):
        last = ends[part][2]
        first = ends[after][1] if after is not None else None
        stitched.append((last.g, last.i, first.i if first is not None and first.g == last.g else None))
    own = linked.filter("kind = 0").select(F.col("g").alias(group), F.col("i").alias(item), "next")
    return own.unionByName(rows.sparkSession.createDataFrame(stitched, own.schema))
