"""Chunk and worker statistics of runs: totals, skew, distribution, extremes.

chunk logs have run_id, worker_id, chunk_id, line, rows, duration, status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import kernels as K


def _ok():
    return F.col("status") == "success"


def totals(chunks: DataFrame) -> DataFrame:
    """Per run: chunks, failed chunks, rows and time of the successful ones, throughput, status."""
    rows, time = F.sum(F.when(_ok(), F.col("rows")).otherwise(0)), F.sum(F.when(_ok(), F.col("duration")).otherwise(0))
    out = chunks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum((~_ok()).cast("long")).alias("n_failed"), rows.alias("total_rows"), time.alias("total_time"))
    out = out.withColumn("throughput", K.guarded_ratio(F.col("total_rows"), F.col("total_time")))
    return out.withColumn("status", F.when(F.col("n_failed") > 0, "FAILED").otherwise("SUCCESS"))


def effective_workers(chunks: DataFrame, planned: int, elapsed_share: float = 1.0) -> DataFrame:
    """Per run: busy time of successful chunks over elapsed time (the longest worker's), within [1, planned]."""
    by_worker = chunks.where(_ok()).groupBy("run_id", "worker_id").agg(F.sum("duration").alias("busy"))
    out = by_worker.groupBy("run_id").agg(F.sum("busy").alias("busy"), (F.max("busy") * elapsed_share).alias("elapsed"))
    return out.withColumn("effective", F.greatest(F.lit(1.0), F.least(F.lit(float(planned)), K.guarded_ratio(F.col("busy"), F.col("elapsed"), float(planned)))))


def workers(chunks: DataFrame) -> DataFrame:
    """Per run and worker: successful chunks, rows, time, and idle share against the run's busiest worker."""
    out = chunks.where(_ok()).groupBy("run_id", "worker_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("rows").alias("rows"), F.sum("duration").alias("busy"))
    longest = F.max("busy").over(Window.partitionBy("run_id"))
    return out.withColumn("idle_pct", F.when(longest > 0, 1 - F.col("busy") / longest).otherwise(0.0))


def skew(chunks: DataFrame) -> DataFrame:
    """Per run: longest chunk over the upper median, its class, and the CV of durations.

    The median comes from a run's chunk durations, at most 200 chunks a plan.
    """
    out = chunks.groupBy("run_id").agg(F.max("duration").alias("longest"), K.upper_median(F.collect_list("duration")).alias("median"), K.cv(F.col("duration")).alias("cv"))
    out = out.withColumn("ratio", K.guarded_ratio(F.col("longest"), F.col("median")))
    return out.withColumn("skew", K.skew_label(F.col("ratio")))


def slowest(chunks: DataFrame, n: int = 3, over: float = 1.5) -> DataFrame:
    """Per run with skew above over: its n slowest chunks."""
    w = Window.partitionBy("run_id").orderBy(F.col("duration").desc(), "chunk_id", "line")
    top = chunks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(skew(chunks).where(F.col("ratio") > over).select("run_id"), "run_id", "left_semi").select("run_id", "rank", "chunk_id", "line", "duration")


def extremes(chunks: DataFrame) -> DataFrame:
    """Per run: its fastest and slowest chunk."""
    tie = lambda sign: F.struct(F.col("duration"), F.col("chunk_id") * sign, F.col("line") * sign)
    return chunks.groupBy("run_id").agg(F.min_by("chunk_id", tie(1)).alias("fastest"), F.min("duration").alias("fastest_s"), F.max_by("chunk_id", tie(-1)).alias("slowest"), F.max("duration").alias("slowest_s"))


def throughput_range(chunks: DataFrame) -> DataFrame:
    """Per run: best and worst chunk throughput, of chunks that took time."""
    return chunks.where("duration > 0").groupBy("run_id").agg(F.max(F.col("rows") / F.col("duration")).alias("peak"), F.min(F.col("rows") / F.col("duration")).alias("low"))


def rule_confidence(fired: DataFrame) -> DataFrame:
    """activations, chunks -> rate and what that does to a run's confidence."""
    rate = K.guarded_ratio(F.col("activations"), F.col("chunks"))
    return fired.withColumn("rate", rate).withColumn("impact", F.when(rate <= 0.05, "note").when(rate <= 0.20, "moderate").otherwise("low")).withColumn("confidence", F.when(F.col("impact") == "note", "full").otherwise(F.col("impact")))
