"""Registration of queries, the driver's tables as the engine's model, and the same model in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import ingest, lexical
from tessera.session import shared_folder
from tessera.sources.registry import file_stamp

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name; integers come out as bigint, as the SQL has them."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(x.name).cast("bigint").alias(x.name) if isinstance(x.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(x.name) for x in df.schema.fields))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks of the documents; a table in fewer pieces than there are cores is dealt out first, larger ones never."""
    docs, cores = read(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.select("doc_id", "text", "lang", "source").repartition(cores)
    return ingest.line_blocks(docs)


def text_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored full-text index of `blocks`, in the shared folder under the stamp of the table's files: the first search of
    a state of the table builds it, every later one reads the parts of its own terms."""
    path = f"{shared_folder(spark)}/text-index-{file_stamp(spark, f'{sf_dir}/documents.parquet')}"
    return lexical.Index.kept(spark, path, lambda: blocks(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as blocks, roles as sections."""
    c = read(spark, sf_dir, "conversations")
    doc = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    return c.select(F.concat(doc, F.lit("/"), F.col("turn").cast("string")).alias("id"), doc.alias("doc_path"), F.concat(doc, F.lit("#"), "role").alias("section_id"), F.col("role").alias("breadcrumb"), F.coalesce("text", F.lit("")).alias("raw"), F.col("turn").alias("ordinal"), F.when(F.col("conv_id") % 4 == 0, "wiki").otherwise("raw").alias("layer"))


# The same in SQL.
FOLD = f"translate(lower(%s), '{X.FOLD_FROM}', '{X.FOLD_TO}')"


def fold_sql(x: str) -> str:
    return FOLD % x


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({fold_sql(x)}, '{X.TOKEN}')"


def mirror_sql(x: str) -> str:
    return f"({x} || ' ' || regexp_replace({x}, '([{X.HAN}])', ' \\1 ', 'g'))"


def hash_sql(x: str) -> str:
    return f"substr(sha256(trim(regexp_replace({x}, '{X.SPACE}', ' ', 'g'))), 1, 16)"


BLOCKS = """docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, source || '/' || doc_id AS doc_path,
         CASE WHEN doc_id % 5 = 0 THEN 'wiki' ELSE 'raw' END AS layer FROM documents),
arrays AS (
  SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS arr FROM docs),
cut AS (SELECT doc_id, lang, source, doc_path, layer, unnest(arr) AS raw, generate_subscripts(arr, 1) - 1 AS ordinal FROM arrays),
blocks AS (
  SELECT doc_path || '#' || source || '/' || ordinal AS id, doc_id, lang, doc_path, doc_path || '#' || source AS section_id,
         source AS breadcrumb, raw, ordinal, layer FROM cut)"""

TURNS = """turns AS (
  SELECT 'conv/' || conv_id || '/' || turn AS id, 'conv/' || conv_id AS doc_path, 'conv/' || conv_id || '#' || role AS section_id,
         role AS breadcrumb, coalesce(text, '') AS raw, turn AS ordinal,
         CASE WHEN conv_id % 4 = 0 THEN 'wiki' ELSE 'raw' END AS layer FROM conversations)"""


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def bm25_sql(q: str, limit: int, rungs: tuple[str, ...] = ("and", "or", "terms"), source: str = "blocks", name: str = "hits") -> str:
    """CTEs that end in `name` (id, score, rung, rank): full-text search over `source`."""
    ps, singles = X.phrases(q), [[X.folded(t)] for t in X.single_terms(q)]

    def count(p: list[str]) -> str:
        if len(p) == 1:
            one = lambda c: f"len(list_filter({c}, lambda t: t = '{p[0]}'))"
        else:
            whole = " " + "  ".join(p) + " "  # tokens are joined by two spaces, so neighbours don't share one
            one = lambda c: f"((length(' ' || array_to_string({c}, '  ') || ' ') - length(replace(' ' || array_to_string({c}, '  ') || ' ', '{whole}', ''))) // {len(whole)})"
        return " + ".join(one(c) for c in ("ti", "tb", "tr"))

    pn = [f"p{k}" for k in range(len(ps))]
    sn = [f"s{k}" for k in range(len(singles))] if singles != ps else pn
    cols = {**dict(zip(pn, ps)), **dict(zip(sn, singles))}
    cond = {"and": " AND ".join(f"{x} > 0" for x in pn), "or": " OR ".join(f"{x} > 0" for x in pn), "terms": " OR ".join(f"{x} > 0" for x in sn)}
    rung = "CASE " + " ".join(f"WHEN hits_{r} > 0 THEN {k + 1}" for k, r in enumerate(rungs)) + " ELSE 0 END"

    def score(names: list[str]) -> str:
        def part(f: str) -> str:
            idf = f"ln((n_ - df_{f} + 0.5) / (df_{f} + 0.5))"
            return f"(CASE WHEN {idf} <= 0 THEN {S.IDF_FLOOR} ELSE {idf} END) * {f} * {S.BM25_K1 + 1} / ({f} + {S.BM25_K1} * (1 - {S.BM25_B} + {S.BM25_B} * dl / avg_))"

        return "round(" + " + ".join(map(part, names)) + ", 6)"

    cases = "CASE rung " + " ".join(f"WHEN {k + 1} THEN {score(sn if r == 'terms' else pn)}" for k, r in enumerate(rungs)) + " END"
    keep = " OR ".join(f"(rung = {k + 1} AND ({cond[r]}))" for k, r in enumerate(rungs))
    words = X.single_terms(q)
    loose = [k + 1 for k, r in enumerate(rungs) if r == "terms" or (r == "or" and singles == ps)]
    held = " + ".join(f"contains(raw, '{w}')::INT" for w in words)
    least = f"WHERE rung NOT IN ({', '.join(map(str, loose))}) OR ({held}) >= {min(2, len(words))}" if len(words) > 1 and loose else ""
    n = name
    return f"""{n}_t AS (SELECT id, raw, {tokens_sql('id')} AS ti, {tokens_sql(mirror_sql('breadcrumb'))} AS tb, {tokens_sql(mirror_sql('raw'))} AS tr FROM {source}),
{n}_f AS (SELECT id, raw, len(ti) + len(tb) + len(tr) AS dl, {', '.join(f'{count(p)} AS {c}' for c, p in cols.items())} FROM {n}_t),
{n}_s AS (SELECT count(*) AS n_, avg(dl) AS avg_, {', '.join(f'count(*) FILTER ({c} > 0) AS df_{c}' for c in cols)}, {', '.join(f'count(*) FILTER ({cond[r]}) AS hits_{r}' for r in rungs)} FROM {n}_f),
{n}_r AS (SELECT *, {rung} AS rung FROM {n}_f, {n}_s),
{n}_o AS (SELECT id, {cases} AS score, rung::BIGINT AS rung, raw FROM {n}_r WHERE {keep} ORDER BY score DESC, id LIMIT {limit}),
{name} AS (SELECT id, score, rung, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM {n}_o {least})"""
