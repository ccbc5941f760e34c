"""Ranked retrieval: fusion, tree, full corpus, vectors, attribution."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X


def ranked(df: DataFrame, order: str = "score") -> DataFrame:
    """A 0-based rank by score, ties by id, for result lists that a limit has bounded."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(order), "id")) - 1)


def rrf(lists: list[tuple[DataFrame, float]], k: int = S.RRF_K) -> DataFrame:
    """id, score: the sum over lists of weight / (k + rank + 1)."""
    parts = [df.select("id", (F.lit(w) / (F.lit(k) + F.col("rank") + 1)).alias("s")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"))


def contribution(rank):
    return 1 / (F.lit(S.RRF_K) + rank + 1)


def tree_search(sections: DataFrame, blocks: DataFrame, query: str, top: int = 3) -> DataFrame:
    """id, rank: the blocks of the best sections by the share of query tokens in title and summary, in their order."""
    import re

    terms = sorted({w for t in X.query_terms(query) for w in re.sub(r"([一-鿿])", r" \1 ", t).lower().split()})
    if not terms:
        return blocks.select("id", F.lit(0).alias("rank")).limit(0)
    hay = F.split(F.lower(X.pad_han(F.concat_ws(" ", "title", "summary"))), X.SPACE)
    share = F.round(F.size(F.array_intersect(hay, F.array(*map(F.lit, terms)))) / len(terms), 6)
    best = sections.select("id", share.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(top)
    best = ranked(best).select(F.col("id").alias("section_id"), F.col("rank").alias("sr"))
    hits = blocks.join(F.broadcast(best), "section_id")  # at most `top` rows
    return hits.select("id", (F.row_number().over(Window.orderBy("sr", "ordinal", "id")) - 1).alias("rank"))


def corpus_size(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("chars"))


def full_corpus(blocks: DataFrame, limit_chars: int = S.FULL_CORPUS_CHARS) -> DataFrame:
    """id, doc_path, ordinal of all blocks, or none where they hold more than the limit; order by the last two."""
    return blocks.crossJoin(F.broadcast(corpus_size(blocks))).filter(F.col("chars") <= limit_chars).select("id", "doc_path", "ordinal")


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a):
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / n)


def knn(vectors: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """id, cosine, rank of the nearest vectors (unit length) to the one row of `query` (vector)."""
    q = F.broadcast(query.select(F.col("vector").alias("q_")).limit(1))
    near = vectors.crossJoin(q).select("id", F.round(dot("vector", "q_"), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(limit)
    return ranked(near, "cosine")


def _stacked(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of up to `size` vectors each: ids and their double components one after another."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            pdf = pdf[pdf["vector"].notna()]
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                rows = [np.asarray(v, dtype=np.float64) for v in part["vector"]]
                if len({len(v) for v in rows}) > 1:
                    raise ValueError("vectors of different lengths")
                yield pd.DataFrame({f"{name}_ids": [part["id"].tolist()], f"{name}_x": [np.stack(rows).tobytes()]})

    return vectors.select("id", "vector").mapInPandas(run, f"{name}_ids array<{id_type}>, {name}_x binary")


def knn_many(vectors: DataFrame, queries: DataFrame, limit: int, rows: int = 4096) -> DataFrame:
    """query, id, cosine, rank of the nearest vectors (unit length, one dimension) to every row of `queries` (id, vector).

    Blocks of queries meet blocks of vectors, a product of matrices each; a pair of blocks returns the best `limit` of each
    of its queries, so what is ranked at the end is small.  A vector of another length than the others is an error.  Null vectors are neither found nor searched for; equal cosines
    are ordered by id."""
    id_type, query_type = (d.schema["id"].dataType.simpleString() for d in (vectors, queries))
    both = _stacked(vectors, rows, "v").crossJoin(_stacked(queries, 512, "q"))

    def run(frames):
        for pdf in frames:
            for v_ids, v_x, q_ids, q_x in zip(pdf["v_ids"], pdf["v_x"], pdf["q_ids"], pdf["q_x"]):
                a, b = (np.frombuffer(x, dtype=np.float64).reshape(len(ids), -1) for x, ids in ((q_x, q_ids), (v_x, v_ids)))
                cosine, ids = np.round(a @ b.T, 6), np.asarray(v_ids)
                least = np.partition(cosine, -limit, axis=1)[:, -limit] if limit < len(ids) else np.full(len(q_ids), -np.inf)
                q, v = np.nonzero(cosine >= least[:, None])  # those at the cut with all that equal them
                best = np.lexsort((ids[v], -cosine[q, v], q))
                q, v = q[best], v[best]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, v = q[place < limit], v[place < limit]
                yield pd.DataFrame({"query": np.asarray(q_ids)[q], "id": ids[v], "cosine": cosine[q, v]})

    found = both.mapInPandas(run, f"query {query_type}, id {id_type}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", rank - 1).filter(F.col("rank") < limit)


def hybrid(lexical: DataFrame, rank_of: DataFrame, limit: int) -> DataFrame:
    """id, score: reciprocal rank of the lexical list plus the graph's gain; the graph never adds candidates."""
    base = rrf([(lexical, 1.0)])
    out = base.join(rank_of, "id", "left").select("id", F.round(F.col("score") + S.GRAPH_GAIN * F.coalesce("pr", F.lit(0.0)), 6).alias("score"))
    return ranked(out.orderBy(F.desc("score"), "id").limit(limit))


def attributed(fused: DataFrame, channels: dict[str, DataFrame]) -> DataFrame:
    """`fused` with a score per channel and the names of the channels that found the row."""
    for name, df in channels.items():
        fused = fused.join(df.select("id", F.round(contribution(F.col("rank")), 6).alias(f"s_{name}")), "id", "left").withColumn(f"s_{name}", F.coalesce(f"s_{name}", F.lit(0.0)))
    names = F.array(*(F.when(F.col(f"s_{n}") > 0, F.lit(n)) for n in channels))
    return fused.withColumn("matched_by", F.filter(names, lambda x: x.isNotNull()))


def source_first(rows: DataFrame) -> DataFrame:
    """Inside the window of results, source rows before derived ones, else in their order."""
    w = Window.orderBy(F.col("layer") != "raw", "rank")
    return rows.withColumn("rank", F.row_number().over(w) - 1)


def encode(blocks: DataFrame, delta: DataFrame, encoder, dims: int) -> DataFrame:
    """id, vector, hash of the blocks that `lifecycle.vector_delta` says to encode: last heading, line feed, text.

    `encoder` maps a list of texts to vectors; they are brought to unit length.  A vector of another size is an error."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = [np.asarray(v, dtype=float) for v in encoder(texts.tolist())]
        if any(v.shape != (dims,) for v in out):
            raise ValueError(f"the encoder must give {dims} numbers")
        return pd.Series([v / (np.linalg.norm(v) or 1.0) for v in out])

    todo = blocks.join(delta.filter("action = 'encode'").select("id"), "id", "left_semi")
    text = F.concat(F.substring_index("breadcrumb", " > ", -1), F.lit("\n"), "raw")
    return todo.select("id", run(text).alias("vector"), "hash")


def check_identity(stored: DataFrame, expected: dict[str, str]) -> DataFrame:
    """The stored vectors' identity (key, value); reading it fails where a key differs from what is expected or is missing."""
    want = F.create_map(*(F.lit(x) for kv in sorted(expected.items()) for x in kv))
    got = stored.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    bad = [F.when(~F.coalesce(F.col("m")[k] == want[k], F.lit(False)), F.lit(k)) for k in sorted(expected)]
    return got.select(F.when(F.concat_ws(",", *bad) == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("vectors were made otherwise: "), F.concat_ws(",", *bad)))).alias("same"))
