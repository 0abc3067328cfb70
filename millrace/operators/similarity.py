"""Context similarity of runs and the throughput estimate that it weighs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import kernels as K
from millrace.operators.decisions import confidence_level

#: Weights of the dimensions; they sum to 1.
WEIGHTS = {"source_load": 0.30, "concurrent": 0.25, "time_band": 0.20, "system_load": 0.15, "network": 0.10}
EXCLUDED, GROWTH, DECAY, MISSING_AGE, DEPTH, DOMINANT = 0.20, 0.50, 0.05, 30.0, 10.0, 0.70


def weights_without_system_load() -> dict[str, float]:
    """The system load's weight shared over the others in proportion, six digits, the largest taking the rest."""
    rest = {k: v for k, v in WEIGHTS.items() if k != "system_load"}
    scale = 1 / sum(rest.values())
    out = {k: round(v * scale, 6) for k, v in rest.items()}
    top = max(out, key=out.__getitem__)
    out[top] = round(1 - sum(v for k, v in out.items() if k != top), 6)
    return out


def score(now: str, then: str) -> Column:
    """Similarity of two contexts (aliases of frames with the dimensions), with the current one's weights."""
    c = lambda side, name: F.col(f"{side}.{name}")
    sims = {
        "source_load": K.load_similarity(c(now, "source_load"), c(then, "source_load")),
        "concurrent": K.gaussian_similarity(c(now, "concurrent"), c(then, "concurrent"), 8.0, 20),
        "time_band": K.band_similarity(c(now, "time_band"), c(then, "time_band")),
        "system_load": K.gaussian_similarity(c(now, "system_load"), c(then, "system_load"), 0.5),
        "network": K.network_similarity(c(now, "network"), c(then, "network")),
    }
    known = c(now, "system_load").isNotNull()
    other = weights_without_system_load() | {"system_load": 0.0}
    total = F.lit(0.0)
    for k, v in sims.items():
        total = total + F.when(known, F.lit(WEIGHTS[k])).otherwise(F.lit(other[k])) * v
    return total


def grown(a: Column, b: Column) -> Column:
    """Whether two row counts differ by more than half of the larger."""
    return F.coalesce(K.guarded_ratio(F.abs(a - b), F.greatest(a, b)) > GROWTH, F.lit(False))


def score_runs(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with score and the reason for leaving one out (null: matched).

    current is one row, so the product with it is no larger than the candidates.
    """
    both = candidates.alias("t").join(F.broadcast(current.alias("n")))
    s = score("n", "t")
    reason = (
        F.when(~F.col("t.has_context"), "no_context_recorded")
        .when(F.col("t.is_benchmark"), "benchmark_run")
        .when(grown(F.col("n.row_estimate"), F.col("t.row_estimate")), "row_growth")
        .when(s < EXCLUDED, "score_too_low")
    )
    return both.select("t.*", F.when(F.col("t.has_context") & ~F.col("t.is_benchmark"), s).otherwise(0.0).alias("score"), reason.alias("reason"))


def estimate(scored: DataFrame, history: DataFrame, fallback: float = 10_000.0) -> DataFrame:
    """One row: context-weighted and smoothed throughput, their blend, the clamped value, confidence and method.

    scored: run_id, score, reason, throughput, age_days; history: seq (oldest first) and throughput of all recent runs.
    """
    matched = scored.where("reason is null").withColumn("w", F.col("score") * F.exp(-DECAY * F.coalesce("age_days", F.lit(MISSING_AGE))))
    m = matched.agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.max("score").alias("best"),
        F.sum("w").alias("weight"),
        F.sum(F.col("w") * F.col("throughput")).alias("weighted"),
        F.max("w").alias("heaviest"),
        F.when(F.count(F.lit(1)) > 1, K.cv(F.col("throughput"))).alias("cv"),
    )
    h = history.agg(
        K.ordered(F.col("seq"), F.col("seq"), F.col("throughput")).alias("s"), F.min("throughput").alias("least"), F.max("throughput").alias("most"), F.sum(F.coalesce(F.col("has_context"), F.lit(False)).cast("int")).alias("depth")
    )
    rows = m.join(h).withColumn("ewma", K.ewma(F.col("s")))
    c = F.col
    use = (c("n_matched") > 0) & (c("weight") >= 1e-6)
    context = F.when(use, c("weighted") / c("weight"))
    alpha = F.when(use, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("best") * F.least(F.lit(1.0), c("depth") / DEPTH)))).otherwise(0.0)
    rows = rows.withColumn("context", context).withColumn("alpha", alpha)
    blended = F.coalesce(c("alpha") * c("context"), F.lit(0.0)) + (1 - c("alpha")) * c("ewma")
    rows = rows.withColumn("blended", blended).withColumn("value", F.greatest(0.75 * c("least"), F.least(1.25 * c("most"), c("blended"))))
    dominant = F.when(use, c("heaviest") / c("weight") > DOMINANT)
    method = F.when(F.size("s") == 0, "cold_start").when(use, "blended").otherwise("ewma")
    level = F.when(use, confidence_level(c("n_matched"), c("best"), c("cv"), dominant)).otherwise("low")
    return rows.select("n_matched", "context", "ewma", "alpha", "blended", F.when(F.size("s") == 0, F.lit(fallback)).otherwise(c("value")).alias("value"), method.alias("method"), level.alias("confidence"))
