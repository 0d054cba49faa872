"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shelfwise-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _temporary()
    return f"{found.rstrip('/')}/shelfwise-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: what many readers share is made once, plans stay short, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(parts: list[DataFrame], name: str) -> DataFrame:
    """parts as one table, in the columns of the first. Each is a job of its own, so the driver never holds a plan of them all."""
    path = f"{shared_dir(parts[0].sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = StructType([StructField(f.name, f.dataType) for f in parts[0].schema])
    for part in parts:
        part.to(schema).write.mode("append").parquet(path)
    return parts[0].sparkSession.read.schema(schema).parquet(path)
