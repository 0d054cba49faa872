"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold; Spark bounds its bytes too. Keeps a worker's memory small when texts are long.
BATCH_ROWS = 512
#: A key is hot when it holds more than this part of all rows; so there are fewer such keys.
HOT_KEYS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shelfwise-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only where driver and executors are one process may the session name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _temporary()
    return f"{found.rstrip('/')}/shelfwise-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Removes all tables that this application's operators wrote in between. Results that were not yet read need them."""
    remove(spark, shared_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later stages read files, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the smallest hash of the keys: a sample that depends on the rows alone.

    Where there are many more rows, all but the lowest hashes are left out before they are ordered, so that what the
    tasks send on stays near n rows however many tasks there are. That share is four times what n calls for.
    """
    total, hashed = rows.count(), F.xxhash64(*keys)
    if total > 8 * n:
        rows = rows.where(hashed < F.lit(-(2**63) + int(4 * n / total * 2**64)))
    return rows.orderBy(hashed, *keys).limit(n)


def within(rows: DataFrame, size, most: int, *keys: str) -> DataFrame:
    """Of a sample, whose rows are bounded already, what fits in most: rows are taken in the order of their hashes, and one
    that doesn't fit is left out alone; those behind it may fit. Only sizes come to the driver."""
    rows, place = written(rows, "sample"), fresh(rows, "__place")
    size = F.coalesce(size, F.lit(0))
    placed = rows.withColumn(place, F.row_number().over(Window.orderBy(F.xxhash64(*keys), *keys, size)))
    taken, left = [], most
    for at, n in sorted(tuple(r) for r in placed.select(place, size).collect()):
        if n <= left:
            taken.append(at)
            left -= n
    return placed.where(F.col(place).isin(taken)).drop(place)


def hot_join(rows: DataFrame, one: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with one, which has each key once, and in `count` how many rows that key has.

    Keys with more than total / HOT_KEYS rows are fewer than HOT_KEYS, whatever the data: that side is broadcast, so no
    task gets all rows of such a key. The others meet in a shuffle, in which no key has more than that share.
    """
    most = max(1, total // HOT_KEYS)
    hot = one.where(F.col(count) > most).drop(count)
    warm = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.where(F.col(count) <= most).drop(count), keys, how)
    return warm.unionByName(rows.join(F.broadcast(hot), keys))


def own_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text alone, of the rows that have an id: other columns can't clash with the operators' own."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def words_of(column: pa.Array) -> list[str]:
    """A string column as str, null as empty."""
    return [x.decode("utf-8", "replace") if x else "" for x in raw(column)]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
