"""Export batches: taken, committed and withdrawn by versions, so that no decision is taken twice.

A batch is planned on what earlier versions left, its rows are written as a table, and it counts once its version is
committed. A planner that another one overtook plans again on the other's version. Withdrawing is a version too: it gives
a batch's decisions and requests back and changes no row of the decision log.

Defined results: a decision made anew after it was taken waits again; with nothing to take no version is made; to
withdraw a batch twice, or one that isn't there, alters nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import decisions
from shelfwise.sources import log

ROWS = "seq long, id string, attr string, hash string, text string, why string"


class Batches:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = log.Versions(spark, f"{self.folder}/_versions")

    def entries(self, upto: int | None = None) -> list[dict]:
        return [self.versions.read(v) for v in self.versions.all() if upto is None or v <= upto]

    def _standing(self, upto: int | None = None) -> list[dict]:
        """Batches that are not withdrawn."""
        entries = self.entries(upto)
        gone = {e["batch_id"] for e in entries if e["kind"] == "withdrawn"}
        return [e for e in entries if e["kind"] == "taken" and e["batch_id"] not in gone]

    def rows(self, upto: int | None = None, withdrawn: bool = False) -> DataFrame:
        """(batch_id, seq, id, attr, hash, text, why) of the batches that stand, or of all."""
        entries = [e for e in self.entries(upto) if e["kind"] == "taken"] if withdrawn else self._standing(upto)
        if not entries:
            return self.spark.createDataFrame([], f"batch_id long, {ROWS}")
        return self.spark.read.schema(f"batch_id long, {ROWS}").parquet(*[e["table"] for e in entries])

    def of_log(self, made: DataFrame, upto: int | None = None) -> DataFrame:
        """The decision log with batch_id of the batches that stand, beside those that it has itself."""
        own = self.rows(upto).where("why = 'change'").select("seq", F.col("batch_id").alias("__batch"))
        return made.join(own, "seq", "left").withColumn("batch_id", F.coalesce(F.col("batch_id").cast("long"), "__batch")).drop("__batch")

    def of_requests(self, asked: DataFrame, upto: int | None = None) -> DataFrame:
        """Requests (id, batch_id) with that of the first standing batch in which their product goes."""
        own = self.rows(upto).groupBy("id").agg(F.min("batch_id").alias("__batch"))
        return asked.join(own, "id", "left").withColumn("batch_id", F.coalesce(F.col("batch_id").cast("long"), "__batch")).drop("__batch")

    def take(self, made: DataFrame, products: DataFrame, checked: DataFrame, limit: int, requests: DataFrame | None = None, *, category: str | None = None, producer: str | None = None, disabled: DataFrame | None = None, note: str = "") -> int | None:
        """Plans and commits a batch of at most `limit` products; its number, or None where nothing waits."""

        def plan(last: int) -> dict | None:
            planned, skipped = decisions.plan(self.of_log(made, last), products, checked, limit, category, producer, disabled)
            own = planned.select("seq", "id", "attr", "hash", "text", F.lit("change").alias("why"))
            at = f"{self.folder}/rows-{uuid.uuid4().hex}"
            if requests is not None:
                room = limit - planned.select("id").distinct().count()
                full = decisions.add_requests(planned, self.of_requests(requests, last), checked, max(0, room))
                own = own.unionByName(full.where("why = 'request'").select(F.lit(None).cast("long").alias("seq"), "id", "attr", F.lit(None).cast("string").alias("hash"), "text", "why"))
            own.select(F.lit(last + 1).cast("long").alias("batch_id"), *own.columns).write.parquet(at)
            n, ids = self.spark.read.parquet(at).agg(F.count_if(F.col("why") == "change"), F.count_distinct("id")).first()
            if not ids:
                return None
            created = self.spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')").first()[0]
            return {"kind": "taken", "batch_id": last + 1, "table": at, "changes": n, "products": ids, "skipped": skipped.count(), "note": note, "created": created}

        number, entry = self.versions.append(plan)
        return number if entry else None

    def withdraw(self, batch_id: int) -> int:
        """Gives a batch's decisions back; how many."""

        def back(last: int) -> dict | None:
            found = [e for e in self._standing(last) if e["batch_id"] == batch_id]
            return {"kind": "withdrawn", "batch_id": batch_id, "changes": found[0]["changes"]} if found else None

        entry = self.versions.append(back)[1]
        return entry["changes"] if entry else 0

    def table(self) -> DataFrame:
        """(batch_id, created, products, decisions, skipped, note, withdrawn): withdrawn ones have no decisions left."""
        entries = self.entries()
        gone = {e["batch_id"] for e in entries if e["kind"] == "withdrawn"}
        rows = [(e["batch_id"], e["created"], e["products"], 0 if e["batch_id"] in gone else e["changes"], e["skipped"], e["note"], e["batch_id"] in gone) for e in entries if e["kind"] == "taken"]
        return self.spark.createDataFrame(rows, "batch_id long, created string, products long, decisions long, skipped long, note string, withdrawn boolean")
