"""Line deduplication by range-partitioned hashes (operator 2).

Every line becomes a 128-bit hash of its key with the document and the position.  Hashes are dealt by range and sorted
by hash, document and position, so one pass meets all occurrences of a line in order and knows after the run in how many
documents it lies; what comes back is a compressed bitmap per document with a bit for each line that stays, not text.
The range key holds the document too: a line that a third of all documents share is spread over many partitions.  A run
that crosses a partition's end is settled by a table of at most two counts per partition.

Input rules: null or empty text is one empty line; null ids are one document; repeated rows of a document share its
bitmap; keys shorter than `min_key` are never dropped; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._shared import discard, enter, materialize, text_or_empty

# Fixed value: the white space that is stripped from both ends of a line.
STRIPPED = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(STRIPPED).lower()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the text's hash: two documents with one id but other texts stay apart."""
    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("t")).withColumn("tk", F.xxhash64("t"))


def _line_rows(min_key: int):
    def run(batches):
        enter("lines")
        for b in batches:
            ids, tks, texts = b.column("id"), b.column("tk").to_numpy(), b.column("t").to_pylist()
            owner, pos, digests = [], [], []
            for k, t in enumerate(texts):
                for p, line in enumerate(t.encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_key and (min_key < 2 or len(key.decode("utf-8", "surrogatepass")) >= min_key):
                        owner.append(k)
                        pos.append(p)
                        digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            own = np.array(owner, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(pa.array(own)), pa.array(tks[own]), pa.array(np.array(pos, dtype=np.int32))], names=["h1", "h2", "id", "tk", "pos"])

    return run


def _stream(min_docs: int, keep_first: bool):
    """Walks the sorted rows of a partition.  Emits kind 0: a line to drop; 1: a line of a run that may cross the
    partition's ends (`n` is 1 for the run's first row); 2: `n` documents of such a run."""

    def run(batches):
        enter("lines")
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        carry: pa.Table | None = None  # the open run as far as it is not settled
        state = {"key": None, "docs": 0, "last": None, "settled": False, "edge": True}

        def out(t: pa.Table, kind, n):
            kind = np.asarray(kind, dtype=np.int32)
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("h1"), t.column("h2"), t.column("id"), t.column("tk"), t.column("pos"))] + [pa.array(kind), pa.array(np.asarray(n, dtype=np.int64)), pa.array(np.full(len(kind), part, dtype=np.int64))], names=["h1", "h2", "id", "tk", "pos", "kind", "n", "part"])

        def settle(t: pa.Table, docs: int, fresh: bool, edge: bool):
            """Rows of one run, all of it or its next part: which go, which wait."""
            first = np.zeros(t.num_rows, dtype=bool)
            first[0] = fresh
            enough = docs >= min_docs
            kind = np.full(t.num_rows, 0 if enough else 1)
            if enough and keep_first:
                kind[first] = 1 if edge else -1
            if not enough and not edge:
                return None
            sel = np.flatnonzero(kind >= 0)
            return out(t.take(pa.array(sel)), kind[sel], first[sel].astype(np.int64)) if len(sel) else None

        def note(t: pa.Table, docs: int):
            return out(t.slice(0, 1), [2], [docs])

        def codes(t: pa.Table) -> np.ndarray:
            """A number per row that changes with the document."""
            return t.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

        for b in batches:
            t = pa.Table.from_batches([b])
            if carry is not None:
                t = pa.concat_tables([carry, t]).combine_chunks()
                carry = None
            if not t.num_rows:
                continue
            h1, h2, doc = t.column("h1").to_numpy(), t.column("h2").to_numpy(), codes(t)
            new_run = np.ones(len(h1), dtype=bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(new_run)
            ends = np.append(starts[1:], len(h1))
            per = np.add.reduceat(new_doc.astype(np.int64), starts)
            begin = 0
            if state["settled"] and (h1[0], h2[0]) == state["key"]:  # goes on from an earlier batch
                part_t = t.slice(0, int(ends[0]))
                same = part_t.column("id")[0].as_py() == state["last"]
                state["docs"] += int(per[0]) - same
                state["last"] = part_t.column("id")[part_t.num_rows - 1].as_py()
                if (x := settle(part_t, state["docs"], False, state["edge"])) is not None:
                    yield x
                begin = 1
                if len(starts) > 1:
                    if state["edge"]:
                        yield note(part_t, state["docs"])
                    state |= {"settled": False, "edge": False, "key": None}
            elif state["settled"]:
                if state["edge"]:
                    yield out(pa.table({"h1": [state["key"][0]], "h2": [state["key"][1]], "id": t.column("id").slice(0, 1), "tk": pa.array([0], pa.int64()), "pos": pa.array([0], pa.int32())}), [2], [state["docs"]])
                state |= {"settled": False, "edge": False, "key": None}
            last = len(starts) - 1
            if begin <= last:
                if state["edge"] and begin < last:  # the partition's first run, whole in this batch
                    run_t = t.slice(int(starts[begin]), int(ends[begin] - starts[begin]))
                    if (x := settle(run_t, int(per[begin]), True, True)) is not None:
                        yield x
                    yield note(run_t, int(per[begin]))
                    state["edge"] = False
                    begin += 1
                if begin < last:  # runs inside: settled here and now
                    drop = np.repeat(per[begin:last] >= min_docs, ends[begin:last] - starts[begin:last])
                    lo = int(starts[begin])
                    if keep_first:
                        drop[starts[begin:last] - lo] = False
                    sel = np.flatnonzero(drop) + lo
                    if len(sel):
                        yield out(t.take(pa.array(sel)), np.zeros(len(sel)), np.zeros(len(sel)))
                run_t = t.slice(int(starts[last]), int(ends[last] - starts[last]))
                if per[last] >= min_docs:  # enough seen: its rows need not wait for its end
                    state |= {"key": (h1[-1], h2[-1]), "docs": int(per[last]), "last": run_t.column("id")[run_t.num_rows - 1].as_py(), "settled": True, "edge": state["edge"]}
                    if (x := settle(run_t, int(per[last]), True, state["edge"])) is not None:
                        yield x
                else:
                    carry = run_t
        if carry is not None:
            d = codes(carry)
            docs = 1 + int((d[1:] != d[:-1]).sum())
            yield settle(carry, docs, True, True)
            yield note(carry, docs)
        elif state["settled"]:
            yield out(pa.table({"h1": pa.array([state["key"][0]], pa.int64()), "h2": pa.array([state["key"][1]], pa.int64()), "id": pa.array([state["last"]], id_type), "tk": pa.array([0], pa.int64()), "pos": pa.array([0], pa.int32())}), [2], [state["docs"]])

    id_type = None

    def typed(batches):
        nonlocal id_type

        def seen():
            nonlocal id_type
            for b in batches:
                id_type = b.column("id").type
                yield b

        yield from run(seen())

    return typed


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_key: int = 1, keep: str = "none") -> DataFrame:
    """One row per document: id, tk (hash of its text), n_lines, n_dropped, bitmap (zlib; bit i: line i stays).

    Lines whose key lies in at least `min_docs` documents go: all of them (`keep="none"`) or all but the first in the
    order of id and position (`keep="first"`)."""
    id_type = df.schema[id_col].dataType.simpleString()
    docs = _keyed(df, id_col, text_col)
    rows = materialize(docs.mapInArrow(_line_rows(min_key), f"h1 bigint, h2 bigint, id {id_type}, tk bigint, pos int"), "line-hashes")
    dealt = rows.repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    found = materialize(dealt.mapInArrow(_stream(min_docs, keep == "first"), f"h1 bigint, h2 bigint, id {id_type}, tk bigint, pos int, kind int, n bigint, part bigint"), "line-runs")
    discard(rows)
    edges = found.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min("part").alias("first_part"))  # at most two rows a partition
    waits = found.filter("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).filter(F.col("docs") >= min_docs)
    if keep == "first":
        waits = waits.filter(~((F.col("n") == 1) & (F.col("part") == F.col("first_part"))))
    drops = found.filter("kind = 0").select("id", "tk", "pos").unionByName(waits.select("id", "tk", "pos")).groupBy("id", "tk").agg(F.collect_set("pos").alias("gone"))
    counts = docs.select("id", "tk", F.size(F.split("t", "\n", -1)).cast("bigint").alias("n_lines")).distinct()
    both = counts.alias("c").join(drops.alias("d"), F.expr("c.id <=> d.id and c.tk = d.tk"), "left").select("c.id", "c.tk", "n_lines", "gone")

    def bits(batches):
        for b in batches:
            maps, lost = [], []
            for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist()):
                keepers = np.ones(n, dtype=np.uint8)
                if gone:
                    keepers[gone] = 0
                lost.append(int(n - keepers.sum()))
                maps.append(zlib.compress(np.packbits(keepers).tobytes(), 6))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tk"), b.column("n_lines"), pa.array(lost, pa.int64()), pa.array(maps, pa.binary())], names=["id", "tk", "n_lines", "n_dropped", "bitmap"])

    maps = materialize(both.mapInArrow(bits, f"id {id_type}, tk bigint, n_lines bigint, n_dropped bigint, bitmap binary"), "line-bitmaps")
    discard(found)
    return maps


def kept_text(text: str, bitmap: bytes) -> str:
    """The lines whose bit is set, joined by a line feed."""
    lines = text.split("\n")
    keepers = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return text if keepers.all() else "\n".join([x for x, k in zip(lines, keepers) if k])


def kept_lines(df: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of `df` as the struct `row_`, with n_lines, n_dropped and the kept text in `kept_`.

    Texts are shuffled once, at any size."""
    names = [f"`{c}`" for c in df.columns]
    left = df.select(F.struct(*names).alias("row_"), df[id_col].alias("id_"), F.xxhash64(text_or_empty(text_col)).alias("tk_"))
    both = left.join(maps.hint("merge"), F.expr("id_ <=> id and tk_ = tk")).select("row_", "n_lines", "n_dropped", "bitmap")

    def run(batches):
        enter("lines")
        for b in batches:
            texts = b.column("row_").field(text_col).to_pylist()
            kept = pa.array([kept_text(t or "", m) for t, m in zip(texts, b.column("bitmap").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row_"), b.column("n_lines"), b.column("n_dropped"), kept], names=["row_", "n_lines", "n_dropped", "kept_"])

    schema = T.StructType([T.StructField("row_", T.StructType(df.schema.fields)), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_", T.StringType())])
    return both.mapInArrow(run, schema)


def apply_bitmaps(df: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept") -> DataFrame:
    """`df` with n_lines, n_dropped and the kept text in `out`; its other columns stay, in order, and columns of these
    names go."""
    done = kept_lines(df, maps, id_col, text_col)
    new = {"n_lines", "n_dropped", out}
    return done.select(*(F.col(f"row_.`{c}`").alias(c) for c in df.columns if c not in new), "n_lines", "n_dropped", F.col("kept_").alias(out))
