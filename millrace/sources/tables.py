"""Tables of a data folder, and the views of them that stand for a run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, source, object, start_time, throughput, status: one run for each event."""
    return load(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.lit("events").alias("source"),
        F.col("user_id").alias("object"),
        F.col("ts").alias("start_time"),
        F.col("value").alias("throughput"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("event_type"),
    )


def chunk_log(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, worker_id, chunk_id, line, rows, duration, status of the chunks of each run."""
    return load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_linenumber").alias("worker_id"),
        F.col("l_orderkey").alias("chunk_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("rows"),
        F.col("l_extendedprice").alias("duration"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("status"),
    )
