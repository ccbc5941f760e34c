"""Session set-up: the settings that the engine is designed for, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_SHIPPED: set[str] = set()
_OWN_FOLDER: dict[str, str] = {}


def session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; other settings are left to the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors unless they import it from their own path."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
        for n in os.listdir(root):
            if n.endswith("_pipeline.py"):
                z.write(os.path.join(root, n), n)
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN_FOLDER[app]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(writer: DataFrameWriter, path: str) -> None:
    """Writes a table; the shuffle files of the write go when it has ended."""
    conf = writer._spark.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str = "knowledge") -> DataFrame:
    """`df` as a table in the shared folder: what several steps read is made once, and its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    write_parquet(df.write, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
