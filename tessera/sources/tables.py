"""Readers and writers of what a knowledge base lies in: folders, ledgers, evaluation files, page tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ingest import frontmatter_map, walk
from tessera.schema import STATES

TOPICS = "qid string, text string"
QRELS = "qid string, run string, docid string, rel int"
CORPUS = "docid string, title string, text string"
VERDICT = "struct<state: string, reason: string, content_hash: string, updated: string>"


def documents(spark: SparkSession, folder: str, layer: str = "raw") -> DataFrame:
    """path, text, layer, title, fm of the Markdown files of a folder."""
    docs = walk(spark, folder, layer)
    docs = docs.withColumn("fm", frontmatter_map(F.col("text")))
    heading = F.nullif(F.regexp_extract("text", r"(?m)^#+\s*(.+?)\s*$", 1), F.lit(""))
    return docs.withColumn("title", F.coalesce(F.get(F.col("fm")["title"], F.lit(0)), heading, F.regexp_replace("path", r"^.*/|\.[^.]*$", "")))


def new_only(content: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of (path, content) whose sha256 isn't among those parsed before (path, sha)."""
    return content.withColumn("sha", F.sha2("content", 256)).join(known.select("path", "sha"), ["path", "sha"], "left_anti")


def ledger(texts: DataFrame, text: str = "text") -> DataFrame:
    """id, state, reason, content_hash, updated from the fenced JSON of ledger pages.

    A page without JSON, with another version or an unknown state is an error, not an empty ledger."""
    raw = F.regexp_extract(text, r"(?s)```json\s*(\{.*\})\s*```", 1)
    schema = f"struct<version: int, blocks: map<string, {VERDICT}>>"
    rows = texts.select(F.from_json(raw, schema, {"mode": "FAILFAST"}).alias("l"))
    rows = rows.select(F.when(F.col("l.version") == 1, F.col("l.blocks")).otherwise(F.raise_error(F.lit("ledger: unknown version"))).alias("b"))
    out = rows.select(F.explode("b").alias("id", "v")).select("id", "v.*")
    good = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise(F.raise_error(F.concat(F.lit("ledger: unknown state "), F.coalesce("state", F.lit("null")))))
    return out.withColumn("state", good)


def ledger_text(rows: DataFrame) -> DataFrame:
    """One row with the ledger page of (id, state, reason, content_hash, updated)."""
    entry = F.struct("id", F.struct("state", "reason", "content_hash", "updated").alias("v"))
    blocks = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return rows.agg(F.concat(F.lit("# State ledger\n\n```json\n"), F.to_json(F.struct(F.lit(1).alias("version"), blocks.alias("blocks"))), F.lit("\n```\n")).alias("text"))


def evaluation(spark: SparkSession, topics: str, qrels: str, corpus: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics and judgements of tab-separated files and a corpus of JSON lines; judgements above zero are gold."""
    tsv = spark.read.option("sep", "\t").option("quote", "")
    gold = tsv.schema(QRELS).csv(qrels).filter("rel > 0").select("qid", F.col("docid").alias("id"))
    return tsv.schema(TOPICS).csv(topics), gold, spark.read.schema(CORPUS).json(corpus)


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """`df` with the columns of a later schema; what is missing gets its default."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Back-up: every table as Parquet; an existing target is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def import_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def page_texts(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]], vision: Callable[[bytes, int], str] | None = None, least: int = 40, pattern: str = "*.pdf") -> DataFrame:
    """path, page, text, ocr of paged files.  `extract` gives the texts of a file's pages; where fewer than half of them
    (one at least) hold `least` characters and there is a `vision` callable, it transcribes each page (bytes, page).

    A file that can't be read has one empty page, a page that can't be transcribed is empty: neither ends the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    texts = [t or "" for t in extract(bytes(content))] or [""]
                except Exception:
                    texts = [""]
                scanned = sum(len(t.strip()) >= least for t in texts) < max(1, len(texts) // 2)
                for k, t in enumerate(texts, 1):
                    if scanned and vision:
                        try:
                            t = vision(bytes(content), k) or ""
                        except Exception:
                            t = ""
                    rows.append((path, k, t, bool(scanned and vision)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "ocr"])

    return files.mapInPandas(run, "path string, page int, text string, ocr boolean")
