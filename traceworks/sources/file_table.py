"""Tables of Parquet files that rows can be deleted from, changed in and loaded anew, one file at a time.

A table is a folder of data files and numbered manifests, each the list of files that make up one version. A change
finds the files that hold rows it touches, writes new files for those only, and publishes the next manifest by a rename,
which fails if another writer was faster. Files are never changed; a job that stops half way leaves files no
manifest names and the version before as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.operators.dedup import keep_last


class Conflict(RuntimeError):
    """Another writer published the version that this one was to be."""


class FileTable:
    """A versioned table below ``path``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """Number of the newest manifest, 0 before the first."""
        folder = self._at(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def files(self, version: int | None = None) -> list[str]:
        """Data files of a version, as names below the table."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._at(f"{self.path}/_manifests/{version:09d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [line for line in text.split("\n") if line]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the newest; None where it has no files."""
        names = self.files(version)
        if not names:
            return None
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{n}" for n in names])

    def _write(self, rows: DataFrame) -> list[str]:
        """Write rows as files of a new folder that nothing names yet."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        found = self._fs.listStatus(self._at(f"{self.path}/{folder}"))
        return sorted(f"{folder}/{s.getPath().getName()}" for s in found if s.getPath().getName().endswith(".parquet"))

    def _publish(self, names: list[str], after: int) -> int:
        """Create the manifest behind version ``after``; its temporary file is renamed only where there is none yet."""
        version = after + 1
        target = self._at(f"{self.path}/_manifests/{version:09d}")
        draft = self._at(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        try:
            out.write("\n".join(names).encode())
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")
        return version

    def append(self, rows: DataFrame) -> int:
        version = self.version()
        return self._publish(self.files(version) + self._write(rows), version)

    def replace(self, rows: DataFrame) -> int:
        """Truncate and load: the next version holds these rows only."""
        version = self.version()
        return self._publish(self._write(rows), version)

    def touched(self, rows: DataFrame | None, condition: Column) -> list[str]:
        """Files with a row that meets ``condition``, at most the files of the table."""
        if rows is None:
            return []
        hit = rows.where(condition).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        return sorted("/".join(r.f.rsplit("/", 2)[1:]) for r in hit)

    def delete(self, condition: Column) -> int:
        """Rows that meet ``condition`` go; files without any stay as they are. Null is not met."""
        version = self.version()
        rows = self.read(version)
        hit = self.touched(rows, condition)
        if not hit:
            return version
        left = self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/{n}" for n in hit]).where(
            ~F.coalesce(condition, F.lit(False)))
        others = [n for n in self.files(version) if n not in set(hit)]
        return self._publish(others + self._write(left), version)

    def upsert(self, incoming: DataFrame, keys: list[str], cursor: list[str]) -> int:
        """Rows merged on ``keys``: the newest by ``cursor`` wins, at equal cursor the incoming one.

        Only files that hold one of the incoming keys are written anew.
        """
        version = self.version()
        stored = self.read(version)
        new = incoming.withColumn("_new", F.lit(1))
        if stored is None:
            return self._publish(self._write(keep_last(new, keys, cursor).drop("_new")), version)
        wanted = incoming.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        places = stored.select(*keys, F.col("_metadata.file_path").alias("_f"))
        hit = sorted("/".join(r["_f"].rsplit("/", 2)[1:])
                     for r in places.join(wanted, same, "left_semi").select("_f").distinct().collect())
        merged = new
        if hit:
            old = self.spark.read.schema(stored.schema).parquet(*[f"{self.path}/{n}" for n in hit])
            merged = old.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        kept = keep_last(merged, keys, [*cursor, "_new"]).drop("_new")
        others = [n for n in self.files(version) if n not in set(hit)]
        return self._publish(others + self._write(kept), version)

    def sync(self, incoming: DataFrame, mode: str, keys: list[str] | None = None, cursor: list[str] | None = None) -> int:
        """Load by the mode's name: overwrite, append, or append with dedup on ``keys``."""
        if mode in ("full_refresh", "overwrite", "truncate"):
            return self.replace(incoming)
        if mode == "append":
            return self.append(incoming)
        if mode in ("incremental", "upsert"):
            if not keys:
                raise ValueError(f"mode {mode} needs key columns")
            return self.upsert(incoming, keys, cursor or [])
        raise ValueError(f"unknown sync mode {mode}")

    def clean(self, keep_versions: int = 1) -> int:
        """Delete data folders that none of the newest versions names; the number of folders deleted."""
        newest = self.version()
        named = {n.split("/")[0] for v in range(max(1, newest - keep_versions + 1), newest + 1) for n in self.files(v)}
        gone = 0
        for s in self._fs.listStatus(self._at(self.path)) if newest else ():
            name = s.getPath().getName()
            if name.startswith("data-") and name not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone
