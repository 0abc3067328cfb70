"""Source profile: key bounds, bucket histogram, skew and what they recommend, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import kernels as K

BUCKETS = 10
SMALL_ROWS, SMALL_BYTES, CHUNK_ROWS, SKEWED = 100_000, 50_000_000, 500_000, 1.0


def key_stats(df: DataFrame, key: str) -> DataFrame:
    """n_rows, pk_min, pk_max: one aggregate over the key column alone."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("pk_min"), F.max(key).alias("pk_max"))


def histogram(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket (from 0), lo, n_rows of equal-width key buckets; the last holds the maximum.

    A key range of no width is one bucket. Two aggregates: bounds, then counts; the
    bounds are one row, joined without a shuffle of the table.
    """
    bounds = df.agg(F.min(key).cast("double").alias("mn"), F.max(key).cast("double").alias("mx"))
    width = (F.col("mx") - F.col("mn")) / buckets
    at = F.when(F.col("mx") > F.col("mn"), F.least(F.floor((F.col(key) - F.col("mn")) / width), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    rows = df.select(key).where(F.col(key).isNotNull()).join(F.broadcast(bounds))
    counts = rows.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = bounds.where("mn is not null").select("*", F.explode(F.when(F.col("mx") > F.col("mn"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))).alias("bucket"))
    out = frame.join(counts, "bucket", "left")
    return out.select("bucket", (F.col("mn") + F.col("bucket") * width).alias("lo"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


def key_cv(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """pk_cv of the histogram."""
    return histogram(df, key, buckets).agg(K.cv(F.col("n_rows").cast("double")).alias("pk_cv"))


def cv_by_group(df: DataFrame, group: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Bucket CV within each group, buckets over the group's own key range, and the scheduling it asks for."""
    bounds = df.groupBy(group).agg(F.min(key).cast("double").alias("mn"), F.max(key).cast("double").alias("mx"))
    width = (F.col("mx") - F.col("mn")) / buckets
    at = F.when(F.col("mx") > F.col("mn"), F.least(F.floor((F.col(key) - F.col("mn")) / width), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    counts = df.select(group, key).join(bounds, group).groupBy(group, at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = bounds.select(group, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    n = F.coalesce("n", F.lit(0)).cast("double")
    out = frame.join(counts, [group, "bucket"], "left").groupBy(group).agg(K.cv(n).alias("pk_cv"))
    return out.withColumn("scheduling", scheduling(F.col("pk_cv")))


def strategy(rows: Column, size: Column, has_key: Column) -> Column:
    small = (rows < SMALL_ROWS) | (size < SMALL_BYTES)
    return F.when(small, "single_pass").when(has_key, "range_chunking").otherwise("single_pass")


def scheduling(pk_cv: Column) -> Column:
    return F.when(pk_cv > SKEWED, "work_stealing").otherwise("round_robin")


def start_workers(rows: Column, has_key: Column, safe: Column) -> Column:
    wanted = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(rows / CHUNK_ROWS)))
    return F.when((rows < SMALL_ROWS) | ~has_key, F.lit(1)).otherwise(F.least(safe, wanted)).cast("int")


def safe_connections(most: Column, active: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0), most - active) / 2)).cast("int")


def avg_row_bytes(size: Column, rows: Column) -> Column:
    return F.when((size > 0) & (rows > 0), F.floor(size / F.greatest(rows, F.lit(1)))).otherwise(F.lit(0)).cast("long")


def recommend(profiles: DataFrame) -> DataFrame:
    """rows, size, has_key, pk_cv, max_conn, active_conn -> the same and strategy, scheduling, workers, row width."""
    c = F.col
    safe = safe_connections(c("max_conn"), c("active_conn"))
    return profiles.select(
        "*",
        avg_row_bytes(c("size"), c("rows")).alias("avg_row_bytes"),
        safe.alias("safe_conn"),
        strategy(c("rows"), c("size"), c("has_key")).alias("strategy"),
        scheduling(c("pk_cv")).alias("scheduling"),
        start_workers(c("rows"), c("has_key"), safe).alias("workers"),
    )
