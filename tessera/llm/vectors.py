"""Near-duplicate vectors by cross-polytope hashing (operator 3).

Each hash flips signs at random and applies the fast Hadamard transform, three times over, and takes the signed axis on
which the rotated vector lies furthest; several hashes make a bucket, several tables of buckets are kept, and a vector
also enters the buckets of its second-best axes.  All pairs inside a bucket are verified by their cosine in double
precision where the bucket is; a pair that meets in several buckets counts in the first of them.  A bucket returns
counts per vector and a spanning forest of its links, never its pairs.

A bucket over `block` vectors is split into blocks; each pair of blocks is a task of its own, so hot buckets are spread
and nothing is capped.  Equal vectors are one representative with a multiplicity.

Input rules: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't meet; null ids get no component; repeated ids count as rows of one vector's class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, enter, materialize, partitions
from tessera.llm.components import components


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def meeting_chance(d: int, cosine: float, hashes: int, probes: int) -> float:
    """The chance that two vectors of that cosine meet in a bucket of one table, less three standard errors: measured on
    normal vectors, which are what the rotations make of any pair."""
    rng = np.random.default_rng([d, hashes, probes])
    n = max(1000, min(20_000, (1 << 22) // (d * hashes)))
    best, cost = [], []
    for _ in range(hashes):
        x = rng.standard_normal((n, d))
        for y in (x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * rng.standard_normal((n, d))):
            a = np.abs(y)
            top = np.argpartition(-a, 1, axis=1)[:, :2]
            top = np.where((a[np.arange(n), top[:, 0]] >= a[np.arange(n), top[:, 1]])[:, None], top, top[:, ::-1])
            best.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            size = np.take_along_axis(a, top, 1)
            cost.append((size[:, 0] - size[:, 1]) / np.linalg.norm(y, axis=1))
    codes = []
    for side in (0, 1):
        losses = np.stack([sum((cost[2 * k + side] for k in range(hashes) if m >> k & 1), np.zeros(n)) for m in range(1 << hashes)], axis=1)
        order = np.argsort(losses, axis=1, kind="stable")[:, :probes]
        codes.append(np.stack([np.take_along_axis(best[2 * k + side], order >> k & 1, 1) for k in range(hashes)], axis=2))
    met = (codes[0][:, :, None] == codes[1][:, None]).all(axis=3).any(axis=(1, 2)).mean()
    return min(0.999, max(1 / n, met - 3 * math.sqrt(met * (1 - met) / n)))


def plan_of(n: int, dim: int, cosine: float = 0.9, miss: float = 1e-3) -> tuple[int, int, int]:
    """Hashes per bucket, tables and probes for n vectors: buckets hold a few vectors each, and a pair at the threshold
    is missed with a chance of `miss`, by the chance that it meets with the probes that are made."""
    d = 1 << max(1, (dim - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(2.0, n / 8)) / math.log(2 * d)))
    probes = min(1 << hashes, 8)
    tables = max(2, math.ceil(math.log(miss) / math.log(1 - meeting_chance(d, cosine, hashes, probes))))
    return hashes, tables, probes


def buckets_of(x: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """Bucket numbers (rows, tables, probes) of unit vectors; the same for equal directions."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    wide = np.zeros((n, d))
    wide[:, :dim] = x
    rng = np.random.default_rng(1_000_003 * dim + 17)
    flips = rng.choice([-1.0, 1.0], (tables, hashes, 3, d))
    out = np.zeros((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        best, second, loss = [], [], []
        for k in range(hashes):
            y = wide
            for r in range(3):
                y = hadamard(y * flips[t, k, r]) / math.sqrt(d)
            a = np.abs(y)
            i = np.argmax(a, axis=1)
            top = a[np.arange(n), i]
            a[np.arange(n), i] = -1
            j = np.argmax(a, axis=1)
            best.append(2 * i + (y[np.arange(n), i] < 0))
            second.append(2 * j + (y[np.arange(n), j] < 0))
            loss.append(top - a[np.arange(n), j])
        cost = np.stack([sum((loss[k] for k in range(hashes) if m >> k & 1), np.zeros(n)) for m in range(1 << hashes)], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        for p in range(order.shape[1]):
            code = np.full(n, dim, dtype=np.int64)
            for k in range(hashes):
                code = code * (2 * d + 1) + np.where(order[:, p] >> k & 1, second[k], best[k])
            out[:, t, p] = code
    return out


def code_kind(dim: int, hashes: int) -> str:
    """The smallest integer that holds the bucket numbers."""
    d = 1 << max(1, (dim - 1).bit_length())
    return "<i4" if (dim + 1) * (2 * d + 1) ** hashes < 1 << 31 else "<i8"


def _rows(hashes: int, tables: int, probes: int, kind: str, codes_as: str):
    """Per usable vector: id, two hash halves, vector, bucket numbers; unusable vectors have a null vector."""

    def run(batches):
        enter("vectors")
        for b in batches:
            v = b.column("v").to_pylist()
            h1, h2, vec, codes = [], [], [], []
            for x in v:
                a = None if not x or any(c is None for c in x) else np.array(x, dtype=np.float64)
                size = 0.0 if a is None or not np.isfinite(a).all() else float(np.linalg.norm(a / (m if (m := np.abs(a).max()) else 1.0)))
                if not size:
                    h1.append(0), h2.append(0), vec.append(None), codes.append(None)
                    continue
                a = a + 0.0  # no negative zero
                d = xxhash.xxh3_128_digest(a.tobytes())
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                vec.append(a)
                codes.append(None)
            for dim in {len(x) for x in vec if x is not None}:
                at = [k for k, x in enumerate(vec) if x is not None and len(x) == dim]
                m = np.stack([vec[k] for k in at])
                m = m / np.abs(m).max(axis=1, keepdims=True)
                c = buckets_of(m / np.linalg.norm(m, axis=1, keepdims=True), hashes, tables, probes)
                for k, row in zip(at, c):
                    codes[k] = row.astype(codes_as).tobytes()
            small = [None if x is None else x.astype(kind).tobytes() for x in vec]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(small, pa.binary()), pa.array(codes, pa.binary())], names=["id", "h1", "h2", "vec", "codes"])

    return run


def _spread(tables: int, probes: int, codes_as: str):
    """A row per bucket of each vector."""

    def run(batches):
        enter("vectors")
        for b in batches:
            n = b.num_rows
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=codes_as).astype(np.int64).reshape(n, tables * probes)
            for lo in range(0, n, 500):
                part = codes[lo : lo + 500]
                own = pa.array(np.repeat(np.arange(lo, lo + len(part)), tables * probes))
                t = np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(part.reshape(-1)), *(b.column(c).take(own) for c in ("id", "m", "vec", "codes"))], names=["t", "code", "id", "m", "vec", "codes"])

    return run


def _verify(num: float, tables: int, probes: int, kind: str, codes_as: str):
    """Reads rows sorted by cell (t, code, i, j); returns kind 0: links of a vector, 1: a link of the spanning forest."""

    def cell(t: int, code: int, i: int, j: int, ids, mult, block, vecs, codes):
        x = np.stack([np.frombuffer(v, dtype=kind) for v in vecs]).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= num
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        if not near.any():
            return None
        lab = np.arange(len(ids))
        while True:
            low = np.minimum(lab, np.where(near, lab[None, :], len(ids)).min(axis=1))
            low = low[low]
            if (low == lab).all():
                break
            lab = low
        a, b = np.nonzero(np.triu(near))
        c = np.stack([np.frombuffer(v, dtype=codes_as).reshape(tables, probes) for v in codes])
        mine = np.ones(len(a), dtype=bool)
        for lo in range(0, len(a), 200_000):
            ca, cb = c[a[lo : lo + 200_000]], c[b[lo : lo + 200_000]]
            for s in range(t):
                mine[lo : lo + 200_000] &= ~(ca[:, s, :, None] == cb[:, s, None, :]).any(axis=(1, 2))
            both = np.where((ca[:, t, :, None] == cb[:, t, None, :]).any(axis=2), ca[:, t], np.iinfo(codes_as).max).min(axis=1)
            mine[lo : lo + 200_000] &= both == code
        a, b = a[mine], b[mine]
        links = np.bincount(a, weights=mult[b], minlength=len(ids)) + np.bincount(b, weights=mult[a], minlength=len(ids))
        tied = np.flatnonzero(lab != np.arange(len(ids)))
        some = np.flatnonzero(links)
        return some, links[some].astype(np.int64), tied, lab[tied]

    def run(batches):
        enter("vectors")
        held: list[tuple] = []
        key = None

        def flush(id_type):
            if len(held) < 2:
                return None
            ids, mult, block, vecs, codes = zip(*held)
            got = cell(*key, ids, np.array(mult), np.array(block), vecs, codes)
            if got is None:
                return None
            some, links, tied, root = got
            n = len(some) + len(tied)
            return pa.RecordBatch.from_arrays([pa.array([0] * len(some) + [1] * len(tied), pa.int32()), pa.array([ids[k] for k in some] + [ids[k] for k in tied], id_type), pa.array([None] * len(some) + [ids[k] for k in root], id_type), pa.array([*links.tolist(), *[0] * len(tied)], pa.int64())], names=["kind", "a", "b", "n"]) if n else None

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("t", "code", "i", "j", "id", "m", "block", "vec", "codes")]
            for t, code, i, j, *row in zip(*cols):
                if key != (t, code, i, j):
                    if (x := flush(b.column("id").type)) is not None:
                        yield x
                    key = (t, code, i, j)
                    held.clear()
                held.append(tuple(row))
            id_type = b.column("id").type
        if held and (x := flush(id_type)) is not None:
            yield x

    return run


def similar_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int = 1000) -> DataFrame:
    """id, n_links, component_id, kept: one row per row of `df`.

    Vectors that are null, empty, zero or hold a null or non-finite entry link with nothing and are their own component.
    Rows of one id are that many rows of the result; equal vectors link; a cosine at the threshold links.  Columns other
    than id and vector are ignored, whatever their names; an empty table gives no rows."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    src = df.select(df[id_col].alias("id"), df[vector_col].alias("v"))
    shape = src.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    hashes, tables, probes = plan_of(shape.n, dim := max(1, shape.d or 1), cosine)
    kind = "<f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    codes_as = code_kind(dim, hashes)
    rows = materialize(src.mapInArrow(_rows(hashes, tables, probes, kind, codes_as), f"id {id_type}, h1 bigint, h2 bigint, vec binary, codes binary"), "vector-rows")
    good = rows.filter("vec is not null and id is not null")
    classes = good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    reps = good.join(classes, ["h1", "h2"]).filter("id = rep").dropDuplicates(["h1", "h2"]).select("id", "m", "vec", "codes")
    spread = reps.mapInArrow(_spread(tables, probes, codes_as), f"t int, code bigint, id {id_type}, m bigint, vec binary, codes binary")
    sizes = reps.select("codes").mapInArrow(_bucket_counts(tables, probes, codes_as), "t int, code bigint, n bigint").groupBy("t", "code").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    sizes = materialize(sizes, "vector-buckets")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = spread.join(sizes, ["t", "code"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks.cast("bigint")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("t", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "m", "block", "vec", "codes")
    cells = dealt.repartition(partitions(spark), "t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j", "id")
    found = materialize(cells.mapInArrow(_verify(cosine, tables, probes, kind, codes_as), f"kind int, a {id_type}, b {id_type}, n bigint"), "vector-links")
    discard(sizes)
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    tied = components(found.filter("kind = 1").select("a", "b"), "vector-components").withColumnRenamed("id", "rep")
    done = classes.join(counts, "rep", "left").join(tied, "rep", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    all_ = rows.withColumn("ok", F.col("vec").isNotNull() & F.col("id").isNotNull()).select("id", "h1", "h2", "ok").join(done.withColumn("ok", F.lit(True)), ["h1", "h2", "ok"], "left")
    out = all_.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _bucket_counts(tables: int, probes: int, codes_as: str):
    def run(batches):
        enter("vectors")
        for b in batches:
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=codes_as).astype(np.int64).reshape(-1, tables * probes)
            t = np.tile(np.repeat(np.arange(tables, dtype=np.int64), probes), len(codes))
            both, n = np.unique(np.stack([t, codes.reshape(-1)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.int32)), pa.array(both[1]), pa.array(n.astype(np.int64))], names=["t", "code", "n"])

    return run
