"""Versions of a folder, and the runs of an import that commit by them.

A version is one small file that is made only if it is not there yet: it is written beside its place and moved there by a
rename that doesn't overwrite. So of two writers that want the same version one wins, and a reader sees a version whole
or not at all. Tables are written before the version that names them. The file system must have that rename (HDFS and
local ones do; object stores need a committer with it).
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Numbered entries in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder.rstrip("/"), spark._jvm

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _context(self):
        path = self._path()
        return self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())

    def all(self) -> list[int]:
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(self._path())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """0 before the first."""
        return max(self.all(), default=0)

    def has(self, version: int) -> bool:
        path = self._path(f"{version:012d}.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, version: int) -> dict:
        path = self._path(f"{version:012d}.json")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, entry: dict) -> bool:
        """False if that version is there already."""
        from py4j.protocol import Py4JJavaError

        beside, place = self._path(f".{uuid.uuid4().hex}"), self._path(f"{version:012d}.json")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(beside, True)
        out.write(json.dumps(entry).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context().rename(beside, place, none)
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if fs.exists(place):
                return False
            raise e
        return True

    def append(self, make, tries: int = 20) -> tuple[int, dict | None]:
        """Commits make(version that is the latest) as the next version; makes it anew each time another writer was first. Where make gives None nothing is committed."""
        for _ in range(tries):
            last = self.latest()
            entry = make(last)
            if entry is None:
                return last, None
            if self.commit(last + 1, entry):
                return last + 1, entry
        raise RuntimeError(f"{self.folder}: other writers were first {tries} times")


class Runs:
    """Tables of runs, each run's part in a partition run_id=N of its table. A run counts once it is committed.

    Saving replaces what an attempt that was not committed left, and a committed run is never written again, so a batch
    that is replayed leaves each row once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, f"{folder.rstrip('/')}/_runs")

    def done(self, run_id: int) -> bool:
        return self.versions.has(run_id)

    def save(self, rows: DataFrame, table: str, run_id: int) -> DataFrame:
        """rows as the run's part of a table, read back."""
        if self.done(run_id):
            raise ValueError(f"run {run_id} is committed")
        path = f"{self.folder}/{table}/run_id={run_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def holds(self, table: str, run_id: int) -> bool:
        """That table has been written by the run, committed or not: Spark marks a whole one."""
        path = self.versions.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/run_id={run_id}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commit(self, run_id: int, **facts) -> bool:
        return self.versions.commit(run_id, facts)

    def latest(self) -> int | None:
        return max(self.versions.all(), default=None)

    def table(self, name: str, run_id: int | None = None) -> DataFrame:
        """Rows of committed runs, or of one of them, with run_id."""
        runs = [r for r in self.versions.all() if run_id is None or r == run_id]
        held = [f"{self.folder}/{name}/run_id={r}" for r in runs if self.holds(name, r)]
        if not held:
            raise AnalysisException(f"no committed run has a table {name}")
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*held)
