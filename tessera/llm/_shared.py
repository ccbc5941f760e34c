"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only where it is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN_ROOT[app]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_folder = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of `materialize` that nothing will read any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_own_folder", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            t._own_folder = None


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def id_remainder(col: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus` (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def crc_mod(value, modulus: int) -> int:
    """`id_remainder` for one Python value."""
    return zlib.crc32(str(value).encode()) % modulus


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions a bigint that `repartition(n, key)` sends there: keys so chosen are dealt evenly."""
    found = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("k")).collect()
    keys = {r.p: r.k for r in found}
    return [keys.get(p, p) for p in range(n)]


def release_memory() -> None:
    """Give a Python worker's free memory back to the system before another large task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what is free


_CLEAR: dict[str, Callable[[], None]] = {}
_ENTERED: list[str] = []


def worker_cache(name: str, clear: Callable[[], None]) -> None:
    """Tell how to empty what an operator keeps in a Python worker between its tasks."""
    _CLEAR[name] = clear


def enter(name: str) -> None:
    """An operator's task begins: what other operators have kept in this worker goes, so their caches never add up."""
    if _ENTERED != [name]:
        _ENTERED[:] = [name]
        for other, clear in _CLEAR.items():
            if other != name:
                clear()
        release_memory()
