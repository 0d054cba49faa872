"""Snapshots that arrive as files: each new one runs once, in its own batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from shelfwise.plans import jobs
from shelfwise.sources import readers


def watch(spark: SparkSession, folder: str, columns: list[str], checkpoint: str, run: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Takes all catalogue files that are new since the checkpoint, one to a batch, and ends. run(products, run_id) saves a snapshot."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(folder, sep=";", header=True, multiLine=True, quote='"', escape='"')
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: run(readers.catalogue(batch), n)).start()


def imports(spark: SparkSession, folder: str, columns: list[str], checkpoint: str, config: dict[str, DataFrame], out: str) -> StreamingQuery:
    """The whole import of each new file, as the run of its batch's number. A batch that Spark replays after a lost driver finds its run committed, or what is left of it replaced."""
    return watch(spark, folder, columns, checkpoint, lambda products, n: jobs.import_products(products, config, out, n))
