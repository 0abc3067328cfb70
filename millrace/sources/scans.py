"""Scans of one table: whole, by key range, by position, by time, by high-water mark, and by database partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def full(df: DataFrame) -> DataFrame:
    return df.select("*")


def key_range(df: DataFrame, key: str, low, high=None) -> DataFrame:
    """low <= key < high; without high, the last chunk: later inserts stay in."""
    out = df.where(F.col(key) >= F.lit(low))
    return out if high is None else out.where(F.col(key) < F.lit(high))


def first_chunk(df: DataFrame, key: str, high) -> DataFrame:
    """Everything below high, rows without a key too: the first chunk is open downwards."""
    return df.where((F.col(key) < F.lit(high)) | F.col(key).isNull())


def probe(df: DataFrame, key: str, low, high) -> DataFrame:
    """How many rows lie in [low, high]."""
    return df.where(F.col(key).between(low, high)).agg(F.count(F.lit(1)).alias("n_rows"))


def incremental(df: DataFrame, key: str, mark) -> DataFrame:
    """Rows beyond the high-water mark; all of them for mark None."""
    return df if mark is None else df.where(F.col(key) > F.lit(mark))


def high_water(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.max(key).alias("mark"))


def offset_chunk(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit by a unique order.

    Only the first offset + limit rows are ranked: a sorted limit takes them with
    a heap in every task, so the ranking never sees the whole table.
    """
    some = df.orderBy(order).limit(offset + limit)
    return some.withColumn("_n", F.row_number().over(Window.orderBy(order))).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")


def time_windows(df: DataFrame, ts: str, width: str) -> DataFrame:
    """Rows and bounds of each time window: the chunks of a table without a numeric key."""
    return df.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("time_start"), F.col("w.end").alias("time_end"), "n_rows")


def range_predicates(key: str, bounds: list[tuple]) -> list[str]:
    """One SQL condition for each chunk, the first open below, the last open above; keys are quoted."""
    name = '"' + key.replace('"', '""') + '"'
    if not bounds:
        return ["1 = 1"]
    if len(bounds) == 1:
        return ["1 = 1"]
    out = [f"({name} < {bounds[0][1]!r} OR {name} IS NULL)"]
    out += [f"{name} >= {lo!r} AND {name} < {hi!r}" for lo, hi in bounds[1:-1]]
    return [*out, f"{name} >= {bounds[-1][0]!r}"]


def jdbc_chunks(spark: SparkSession, url: str, table: str, key: str, bounds: list[tuple], properties: dict | None = None) -> DataFrame:
    """A database table with one Spark partition for each chunk."""
    return spark.read.jdbc(url, table, predicates=range_predicates(key, bounds), properties=properties or {})
