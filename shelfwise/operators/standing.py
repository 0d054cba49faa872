"""The review queue as a table that follows its inputs.

Findings with their product, latest decision and verdict are joined once for a run and kept in parts by product. New
decisions and verdicts are changes: only the parts of their products are read and written again, all others are taken
over. Each state is a version (sources.log.Versions) that names the parts' folders; a reader takes the latest whenever it
asks, so a decision made between two pages shows on the second. Two writers can't lose each other's changes: the later one
applies its own to the other's version.

Defined results: changes for products or cells that the queue doesn't have alter nothing; a change older than what a row
holds alters nothing, so changes may come late, in any order and twice; of changes to one cell the last by (ts, seq) counts;
a decision taken back leaves the finding open.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.functions.text import value_hash
from shelfwise.operators import review
from shelfwise.sources import log

PARTS = 32
_HELD = ("status", "decided_value", "batch_id", "decided_ts", "decided_seq", "verdict", "verdict_seq")


def inputs_of(spark: SparkSession, *paths: str) -> str:
    """Names the state of files: their paths, sizes and times."""
    out = []
    for path in paths:
        for file in sorted(spark.read.parquet(path).inputFiles()):
            at = spark._jvm.org.apache.hadoop.fs.Path(file)
            status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
            out.append(f"{file}:{status.getLen()}:{status.getModificationTime()}")
    return "|".join(out)


class Queue:
    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self.versions = log.Versions(spark, f"{self.folder}/_versions")

    def _part(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Part → folder, of the parts that rows have."""
        at = f"{self.folder}/{uuid.uuid4().hex}"
        rows.withColumn("part", self._part()).repartition("part").write.partitionBy("part").parquet(at)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(fs_path)]
        return {n.removeprefix("part="): f"{at}/{n}" for n in names if n.startswith("part=")}

    def build(self, findings: DataFrame, products: DataFrame, decisions: DataFrame, verdicts: DataFrame | None = None, inputs: str = "") -> int:
        """The queue of a run, made anew. inputs names their state for follows()."""
        rows = review.base(findings, products, decisions, verdicts)
        for name, kind in (("verdict", "string"), ("verdict_seq", "long")):
            rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
        written = self._write(rows)
        entry = {"parts": written, "schema": rows.schema.json(), "inputs": inputs, "rewritten": sorted(written, key=int)}
        return self.versions.append(lambda last: entry)[0]

    def version(self) -> int:
        return self.versions.latest()

    def follows(self, inputs: str) -> bool:
        """The queue was made of this state of its inputs."""
        last = self.version()
        return bool(last) and self.versions.read(last)["inputs"] == inputs

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.versions.read(self.version() if version is None else version)
        return self._rows(entry, list(entry["parts"].values()))

    def _rows(self, entry: dict, paths: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _change(self, changes: DataFrame, apply) -> int:
        """apply(rows, changes) → rows, of the parts that changes touch alone."""
        touched = [str(r[0]) for r in changes.select(self._part()).distinct().collect()]  # so many at most as there are parts

        def make(last: int) -> dict:
            entry = self.versions.read(last)
            paths = [entry["parts"][p] for p in touched if p in entry["parts"]]
            new = self._write(apply(self._rows(entry, paths), changes)) if paths else {}
            return {**entry, "parts": entry["parts"] | new, "rewritten": sorted(new, key=int)}

        return self.versions.append(make)[0]

    def decide(self, decisions: DataFrame) -> int:
        """New rows of the decision log: (id, attr, old_value, status, new_value, ts, seq, batch_id)."""
        mine = review.latest(decisions.withColumn("hash", value_hash(F.col("old_value"))), ["id", "attr", "hash"], ("ts", "seq"))
        state = review.decision_state()
        mine = mine.select("id", "attr", "hash", F.struct(state.alias("status"), F.when(state.isNotNull(), F.col("new_value")).alias("decided_value"), F.when(state.isNotNull(), F.col("batch_id").cast("long")).alias("batch_id"), F.col("ts").alias("decided_ts"), F.col("seq").cast("long").alias("decided_seq")).alias("__new"))

        def apply(rows: DataFrame, changes: DataFrame) -> DataFrame:
            later = F.col("__new").isNotNull() & (F.col("decided_ts").isNull() | (F.struct("__new.decided_ts", "__new.decided_seq") > F.struct("decided_ts", "decided_seq")))
            met = rows.join(changes, ["id", "attr", "hash"], "left")
            return met.select(*(F.when(later, F.col(f"__new.{c}")).otherwise(F.col(c)).cast(t).alias(c) if c in _HELD[:5] else F.col(c) for c, t in rows.dtypes))

        return self._change(mine, apply)

    def judge(self, verdicts: DataFrame) -> int:
        """New verdicts: (id, attr, verdict, seq)."""
        mine = review.latest(verdicts, ["id", "attr"], ("seq",)).select("id", "attr", F.struct(F.col("verdict"), F.col("seq").cast("long").alias("verdict_seq")).alias("__new"))

        def apply(rows: DataFrame, changes: DataFrame) -> DataFrame:
            later = F.col("__new").isNotNull() & (F.col("verdict_seq").isNull() | (F.col("__new.verdict_seq") > F.col("verdict_seq")))
            met = rows.join(changes, ["id", "attr"], "left")
            return met.select(*(F.when(later, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in _HELD[5:] else F.col(c) for c in rows.columns))

        return self._change(mine, apply)

    def clean(self, keep: int = 2) -> None:
        """Removes folders that none of the last versions names. A reader of an older version would miss them."""
        named = {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for v in self.versions.all()[-keep:] for p in self.versions.read(v)["parts"].values()}
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(top):
            if f.isDirectory() and f.getPath().getName() not in named | {"_versions"}:
                fs.delete(f.getPath(), True)
