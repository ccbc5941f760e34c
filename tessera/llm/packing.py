"""Packing along a space-filling curve (operator 1).

Every document becomes a signed hashed token vector, projected to a few dimensions; the Hilbert key of that point
orders the documents, a range partitioning with a sort inside deals the curve out, and each partition fills sequences
with neighbouring documents.  A document is cut only where a sequence is full.  What is left at the end of a partition
goes into sequences whose sizes are the powers of two of its binary form, so nothing is padded.

Input rules: null text is the empty text; a document without tokens still has its end mark; equal keys are ordered by
id, so a large group of copies is dealt over several partitions; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm._shared import materialize, text_or_empty

SEQUENCE = 2048
END_ID = 1
BUCKETS = 256


def token_projection(vocab_size: int, dims: int) -> np.ndarray:
    """For each token id the row of a Gaussian projection that its hash bucket has, with the sign of its hash."""
    x = np.arange(1, vocab_size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    rows = np.random.default_rng(7).standard_normal((BUCKETS, dims))[(x % np.uint64(BUCKETS)).astype(np.int64)]
    return (rows * np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)[:, None]).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid cells (n rows, d columns of `bits` bits); d * bits < 64."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the reflections and rotations of each level
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], dtype=np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _cut(pieces: list[tuple], sizes: list[int]):
    """Deal pieces (doc, start, length, ...) out to sequences of the given sizes, in order."""
    out, k, room = [], 0, sizes[0] if sizes else 0
    for doc, start, length, total, ids in pieces:
        while length:
            take = min(room, length)
            out.append((k, sizes[k] - room, doc, start, take, total, ids))
            start, length, room = start + take, length - take, room - take
            if not room and k + 1 < len(sizes):
                k += 1
                room = sizes[k]
    return out


class _Packer:
    """Fills the sequences of one partition."""

    def __init__(self, first_id: int, size: int):
        self.seq, self.size, self.open, self.fill = first_id, size, [], 0

    def add(self, doc, ids: np.ndarray):
        """Rows (sequence, offset, doc, start, length, total, ids) of the sequences that this document fills."""
        start, total = 0, len(ids)
        while start < total:
            take = min(self.size - self.fill, total - start)
            self.open.append((doc, start, take, total, ids))
            self.fill += take
            start += take
            if self.fill == self.size:
                yield from ((self.seq, *row[1:]) for row in _cut(self.open, [self.size]))
                self.seq, self.open, self.fill = self.seq + 1, [], 0

    def close(self):
        sizes = [1 << b for b in range(self.fill.bit_length() - 1, -1, -1) if self.fill >> b & 1]
        yield from ((self.seq + row[0], *row[1:]) for row in _cut(self.open, sizes))


def pack(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, dims: int = 4, bits: int = 8) -> DataFrame:
    """One row per piece: the id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    `size` is a power of two.  The token table is written once to the shared folder, as range partitioning samples its
    input first; the corpus statistics that scale the grid are a mean and a deviation per dimension.

    Null and empty texts are the end id alone; very long texts are cut over as many sequences as they take; repeated rows
    and null ids are documents of their own; documents of one place on the curve follow one another by id.  Columns other
    than id and text are ignored, whatever their names; an empty table gives no rows."""
    id_type = df.schema[id_col].dataType.simpleString()
    axes = [f"c{i}" for i in range(dims)]

    def tokens(batches):
        vocab = bpe.load(vocab_path)
        cache = bpe.cache_of(vocab_path, "ids", bytes)
        project, kind, end = token_projection(max(vocab.size, end_id + 1), dims), vocab.kind, vocab.pack(end_id)
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in bpe.chunks(texts):
                made, at, offsets = cache.look_up(texts[lo:hi])
                flat = np.frombuffer(b"".join(made), dtype=kind)
                sizes = np.fromiter(map(len, made), dtype=np.int32, count=len(made)) // kind.itemsize
                first = np.cumsum(sizes, dtype=np.int32) - sizes
                per = sizes[at]
                ends = np.cumsum(per, dtype=np.int32)
                ids = flat[np.repeat(first[at] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
                cut = np.concatenate(([0], ends))[offsets]
                run_sums = np.add.reduceat(project[flat], np.minimum(first, len(flat) - 1), axis=0) if len(flat) else np.zeros((len(made), dims), dtype=np.float32)
                run_sums[sizes == 0] = 0
                points = np.add.reduceat(run_sums[at], offsets[:-1], axis=0) / np.maximum(1, np.diff(cut))[:, None]  # a text has one run at least
                raw, cut = ids.tobytes(), (cut * kind.itemsize).tolist()
                blobs = [raw[x:y] + end for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(blobs, pa.binary()), *(pa.array(points[:, i].astype(np.float64)) for i in range(dims))], names=["id", "ids", *axes])

    toks = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(tokens, f"id {id_type}, ids binary, " + ", ".join(f"{a} double" for a in axes))
    toks = materialize(toks, "pack-tokens")
    stats = toks.agg(*(f(a).alias(f"{n}{a}") for a in axes for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mid = np.array([stats[f"m{a}"] or 0.0 for a in axes])
    dev = np.array([stats[f"s{a}"] or 1.0 for a in axes])

    @F.pandas_udf("bigint")
    def curve(*cols: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy() for c in cols], axis=1) - mid) / dev
        unit = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))
        return pd.Series(hilbert_key(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits))

    def fill(batches):
        wide = bpe.load(vocab_path).kind
        packer = _Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, size)

        def rows(found):
            found = list(found)
            cols = list(zip(*found)) if found else [[]] * 7
            ids = [x[s : s + n].astype("<u4").tobytes() for x, s, n in zip(cols[6], cols[3], cols[4])]
            arrays = [pa.array(cols[2], id_arrow), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        id_arrow = pa.int64()
        for b in batches:
            id_arrow = b.column("id").type
            docs, ids = b.column("id").to_pylist(), b.column("ids").to_pylist()
            for lo in range(0, len(docs), 1000):
                yield rows(r for d, x in zip(docs[lo : lo + 1000], ids[lo : lo + 1000]) for r in packer.add(d, np.frombuffer(x, dtype=wide)))
        yield rows(packer.close())

    keyed = toks.select("id", "ids", curve(*axes).alias("key"))
    ordered = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("id", "ids")
    return ordered.mapInArrow(fill, f"`{id_col}` {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
