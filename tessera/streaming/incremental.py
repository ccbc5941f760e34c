"""Incremental ingest: new document files become blocks, each file once, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ingest import line_blocks


def block_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A stream of blocks over a folder to which document files are added, or over all paths of a pattern."""
    return line_blocks(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def ingest(spark: SparkSession, path: str, schema, out: str, state: str) -> StreamingQuery:
    """Everything that is there now, appended to `out`; `state` remembers the files, so a restart goes on from there."""
    return block_stream(spark, path, schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
