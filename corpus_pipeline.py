"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage returns to the shared folder
and reads it again as the next stage's documents.  All stages but the last return the columns of `documents`.

Rows with null or empty texts: they can't be toxic, the language stage rejects them.  An empty table passes through.
Texts of any length go through whole; repeated rows of one id are judged alike and stay or go together.
Columns beyond those of `documents` are kept, whatever their names; `text` and `n_chars` follow the line stage.
A stage lowers the session's rows in an Arrow batch to 2,000 where it is more: a batch lies outside the heap, whole texts and all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, lines, packing, registry, toxicity
from tessera.llm._shared import discard, materialize, table, text_or_empty

OWN = "tessera_own_"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2000


def small_batches(stage: Callable) -> Callable:
    """The stage with at most `ROWS` rows in an Arrow batch, also when its result is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= ROWS:
            spark.conf.set(BATCH, str(ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn(OWN, toxicity.toxicity_column(model, text_or_empty()))
    return scored.filter(F.col(f"{OWN}.score") < 0.5).drop(OWN)


@small_batches
def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is less likely than not, go."""
    net = langid.fit(docs)
    named = docs.withColumn(OWN, langid.language_column(net, text_or_empty()))
    return named.filter((F.col(f"{OWN}.lang_pred") != langid.UNKNOWN) & (F.col(f"{OWN}.score") >= 0.5)).drop(OWN)


@small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents share stay where they come first; documents that lose every line go."""
    maps = lines.keep_bitmaps(docs, min_docs=10, min_key=1, keep="first")
    kept = lines.kept_lines(docs, maps).filter((F.col("n_dropped") == 0) | F.col("kept_").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_")).otherwise(F.col("row_.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_")).otherwise(F.col("row_.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(new.get(c, F.col(f"row_.`{c}`")).alias(c) for c in docs.columns))


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles are alike to 0.8 or more, the one of the smallest id stays."""
    groups = jaccard.similar_documents(docs, n=5, num=80, den=100)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


@small_batches
def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens along the Hilbert curve."""
    pieces = packing.pack(docs, registry.vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack_documents),
]

#: No SQL states the learned stages; tests compare the line and copy stages with a slow version, and check that the others keep
#: clean documents and the columns.  The operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
