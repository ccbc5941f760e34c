"""Versions of stored tables: readers pin one snapshot, writers publish the next by one rename.

A version is a small page that names the folders of every table; the tables are Parquet.  Folders are never written
twice, so what a reader has pinned stays as it was while others publish.  The folder must lie where a rename is atomic and
never replaces a file (HDFS, local disks), as on stores without such a rename two writers could publish one version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import discard, write_parquet

WHOLE = "all"


class Superseded(RuntimeError):
    """Another writer has published the version that this one was to become."""


@dataclass(frozen=True)
class Entry:
    """A table of a version: its folders by part, its schema, the stamp of what it was made from, numbers about it."""

    parts: dict[str, str]
    schema: str
    stamp: str = ""
    facts: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Snapshot:
    """One version: what it reads doesn't change when others publish."""

    spark: SparkSession
    version: int
    entries: dict[str, Entry]
    marks: dict[str, str] = field(default_factory=dict)

    def has(self, name: str, stamp: str | None = None) -> bool:
        return name in self.entries and stamp in (None, self.entries[name].stamp)

    def table(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its parts."""
        e = self.entries[name]
        schema = T.StructType.fromJson(json.loads(e.schema))
        folders = sorted(set(e.parts.values() if parts is None else (e.parts[p] for p in parts if p in e.parts)))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


class Registry:
    """Versions under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if name.startswith(self.root) else f"{self.root}/{name}")

    def _fs(self):
        return self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, at = self._fs(), self._path("versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last version, or an earlier one; version 0, without tables, where nothing has been published."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot(self.spark, 0, {})
        stream = self._fs().open(self._path(f"versions/{version:012d}.json"))
        try:
            page = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(self.spark, version, {k: Entry(**e) for k, e in page["entries"].items()}, page["marks"])

    def write(self, df: DataFrame, by: str | None = None) -> Entry:
        """`df` stored under a folder of its own, not yet part of a version; a part for each value of the column `by`."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != by])
        if by is None:
            write_parquet(df.write, folder)
            return Entry({WHOLE: folder}, schema.json())
        write_parquet(df.write.partitionBy(by), folder)
        made = (s.getPath().getName() for s in self._fs().listStatus(self._path(folder)) if s.isDirectory())
        return Entry({n.split("=", 1)[1]: f"{folder}/{n}" for n in made if "=" in n}, schema.json())

    def publish(self, base: Snapshot, entries: dict[str, Entry], drop: tuple[str, ...] = (), marks: dict[str, str] | None = None) -> Snapshot:
        """The version after `base`: its tables, with these in their place.  Fails with `Superseded` where it exists already."""
        after = {k: e for k, e in base.entries.items() if k not in drop} | entries
        noted = base.marks | (marks or {})
        page = json.dumps({"entries": {k: e.__dict__ for k, e in after.items()}, "marks": noted}, sort_keys=True)
        fs, new, final = self._fs(), self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{base.version + 1:012d}.json")
        stream = fs.create(new, False)
        stream.write(bytearray(page.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(self._conf).getUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(final), never_over)
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(final):
                raise Superseded(f"version {base.version + 1} exists") from e
            raise
        return Snapshot(self.spark, base.version + 1, after, noted)

    def derived(self, name: str, stamp: str, build: Callable[[], DataFrame], tries: int = 5) -> tuple[DataFrame, bool]:
        """A table that follows from others, and whether it was built now: the stored one where it was made from a corpus of
        this stamp, else what `build` makes, stored and published under the stamp.  `build` runs once at most."""
        entry = None
        for _ in range(tries):
            now = self.snapshot()
            if now.has(name, stamp):
                return now.table(name), False
            if entry is None:
                made = self.write(build())
                entry = Entry(made.parts, made.schema, stamp)
            try:
                return self.publish(now, {name: entry}).table(name), True
            except Superseded:
                continue  # another writer was first: look again whether it stored the same
        raise Superseded(f"{name}: {tries} other writers were first")

    def forget(self, keep: int = 2) -> int:
        """Deletes all but the last versions and the folders that none of those names; returns the number of folders.

        Not to be run beside a writer: what it has written but not published yet has no name."""
        kept = [self.snapshot(v) for v in self.versions()[-keep:]]
        named = {p for s in kept for e in s.entries.values() for p in e.parts.values()}
        roots = {p.split("/data/", 1)[1].split("/")[0] for p in named}
        for v in self.versions()[:-keep]:
            self._fs().delete(self._path(f"versions/{v:012d}.json"), False)
        at, gone = self._path("data"), 0
        for s in self._fs().listStatus(at) if self._fs().exists(at) else []:
            if s.getPath().getName() not in roots:
                discard(self.spark, f"{self.root}/data/{s.getPath().getName()}")
                gone += 1
        return gone

    def drop(self) -> None:
        discard(self.spark, self.root)


def file_stamp(spark: SparkSession, *paths: str) -> str:
    """One digest of the names, sizes and times of the files below `paths`: it costs a listing, no data is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return stamp_of(files=(files.select("path", "length", F.unix_micros("modificationTime").alias("at")), ("path", "length", "at")))


def stamp_of(**tables: tuple[DataFrame, tuple[str, ...]]) -> str:
    """One digest of the contents of tables (frame, columns), whatever the order of their rows.

    Every column's text is written with its length, so no two layouts of rows give the same bytes; a row counts by two
    halves of its digest, which are summed, so rows may come in any order and from any number of tasks."""
    from tessera.operators.lifecycle import corpus_stamp

    rows = [corpus_stamp(df, *cols).select(F.lit(name).alias("name"), "n", "stamp") for name, (df, cols) in sorted(tables.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    whole = out.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n", "stamp"))), lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"), x["stamp"])), "|").cast("binary"), 256))
    return whole.first()[0]
