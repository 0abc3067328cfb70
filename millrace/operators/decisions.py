"""Decisions as expressions over small tables of declared settings: workers, advisories, verdicts, costs, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import kernels as K

LEAST_FACTOR, LOW_FACTOR, CRITICAL_FACTOR = 0.25, 0.75, 1.25


def _int(x: Column) -> Column:
    return F.floor(x).cast("int")


def base_workers(rows: DataFrame) -> DataFrame:
    """bench_conf, bench_signal, bench_workers, ctl_throughput, ctl_workers, prof_workers, safe, cores, cap -> workers, source.

    A trusted benchmark beats the controller, which beats the profiler; the result is within
    the safe connections, the cores and the cap (64 if none).
    """
    c = F.col
    bench = F.when(c("bench_conf") >= 0.5, F.when(c("bench_signal") <= 0.3, F.least(c("bench_workers"), F.lit(2))).otherwise(c("bench_workers")))
    ctl = F.when(c("ctl_throughput") > 0, c("ctl_workers"))
    base = F.coalesce(bench, ctl, c("prof_workers"))
    source = F.when(bench.isNotNull(), "benchmark").when(ctl.isNotNull(), "controller").otherwise("profiler")
    return rows.withColumn("base", base).withColumn("origin", source).withColumn("workers", F.greatest(F.lit(1), F.least(base, c("safe"), c("cores"), F.coalesce("cap", F.lit(64)))))


def waterfall(rows: DataFrame) -> DataFrame:
    """base, per_worker_mb and a runtime context's columns -> after_caps, factor, after_factors, workers.

    Order: hard caps, the product of the environment's factors (a quarter at least), priority, at least one
    worker; no connection left gives 0. All roundings go down.
    """
    c = F.col
    base = F.greatest(F.lit(1), c("base"))
    left = c("max_connections") - F.coalesce("concurrent", F.lit(0))
    none = c("max_connections").isNotNull() & c("concurrent").isNotNull() & (left <= 0)
    by_memory = F.when(c("per_worker_mb") > 0, _int(c("max_memory_mb") / c("per_worker_mb")))
    caps = F.greatest(F.lit(1), F.least(base, F.when(c("max_connections").isNotNull(), left), by_memory))
    network = F.when(c("network") == "degraded", 0.75).when(c("network") == "poor", 0.5).otherwise(1.0)
    load = F.when(c("load") == "high", 0.5).otherwise(1.0)
    upkeep = F.when(F.coalesce(c("maintenance"), F.lit(False)), 0.5).otherwise(1.0)
    rows = rows.withColumn("none", F.coalesce(none, F.lit(False))).withColumn("after_caps", caps).withColumn("factor", F.greatest(F.lit(LEAST_FACTOR), network * load * upkeep))
    rows = rows.withColumn("after_factors", F.greatest(F.lit(1), _int(c("after_caps") * c("factor"))))
    final = F.when(c("priority") == "low", F.greatest(F.lit(1), _int(c("after_factors") * LOW_FACTOR))).when(c("priority") == "critical", F.least(c("after_caps"), _int(c("after_factors") * CRITICAL_FACTOR))).otherwise(c("after_factors"))
    rows = rows.withColumn("workers", F.greatest(F.lit(1), final))
    for name in ("after_caps", "after_factors", "workers"):
        rows = rows.withColumn(name, F.when(c("none"), 0).otherwise(c(name)).cast("int"))
    return rows.withColumn("factor", F.when(c("none"), 1.0).otherwise(c("factor"))).drop("none")


SEVERITY = ["fail", "warn", "pass"]


def advisories(rows: DataFrame) -> DataFrame:
    """est_minutes, out_bytes and declared limits -> one row for each limit that is declared: field, severity, rank."""
    c = F.col
    gb, mb = c("out_bytes") / float(1 << 30), c("out_bytes") / float(1 << 20)
    found = [
        ("target_duration", c("target_minutes"), F.when(c("est_minutes") > c("target_minutes"), "warn").otherwise("pass")),
        ("maintenance_window", c("window_minutes"), F.when(c("est_minutes") > c("window_minutes"), "fail").otherwise("pass")),
        ("disk", c("disk_gb"), F.when(gb > c("disk_gb"), "fail").when(gb > c("disk_gb") * 0.8, "warn").otherwise("pass")),
        ("egress_budget", c("egress_mb"), F.when(mb > c("egress_mb"), "warn").otherwise("pass")),
    ]
    every = F.array(*(F.struct(F.lit(n).alias("field"), F.when(limit.isNotNull(), s).alias("severity")) for n, limit, s in found))
    out = rows.select("*", F.explode(every).alias("a")).select(*rows.columns, "a.field", "a.severity").where("severity is not null")
    return out.withColumn("rank", F.array_position(F.array(*map(F.lit, SEVERITY)), c("severity")).cast("int"))


def verdicts(rows: DataFrame, key: str) -> DataFrame:
    """Advisory rows and resolved workers of each key -> verdict, first match wins."""
    def has(severity: str, *fields: str) -> Column:
        hit = F.col("severity") == severity
        if fields:
            hit = hit & F.col("field").isin(*fields)
        return F.coalesce(F.bool_or(hit), F.lit(False))

    out = rows.groupBy(key).agg(F.min("workers").alias("workers"), has("fail", "maintenance_window", "disk").alias("stop"), (has("fail") | has("warn")).alias("look"))
    verdict = F.when((F.col("workers") == 0) | F.col("stop"), "not_recommended").when(F.col("look"), "safe_with_warnings").otherwise("safe")
    return out.select(key, verdict.alias("verdict"))


def fallback_throughput(p50_ms: Column, row_bytes: Column, workers: Column) -> Column:
    """Rows a second to expect without history: from latency, else from bandwidth, else 10,000; 500,000 at most."""
    scale = F.sqrt(workers)
    by_latency = F.least(F.lit(500_000.0), 1000 / F.greatest(p50_ms, F.lit(1e-9)) * 100 * scale)
    by_bytes = F.least(F.lit(500_000.0), 25.0 * 1024 * 1024 * scale / F.greatest(row_bytes, F.lit(1)))
    return F.when(p50_ms > 1, by_latency).when(row_bytes > 0, by_bytes).otherwise(F.lit(10_000.0))


# Costs.


def costs(rows: DataFrame) -> DataFrame:
    """seconds, out_bytes, workers, compute_rate, egress_rate, connection_rate -> compute, egress, connections, total."""
    hours = F.col("seconds") / 3600.0
    parts = {"compute": hours * F.col("compute_rate"), "egress": F.col("out_bytes") / float(1 << 30) * F.col("egress_rate"), "connections": F.col("workers") * hours * F.col("connection_rate")}
    total = parts["compute"] + parts["egress"] + parts["connections"]
    finite = ~F.isnan(total) & (F.abs(total) < float("inf"))
    out = rows.withColumns({k: F.when(finite, v).otherwise(0.0) for k, v in (parts | {"total": total}).items()})
    return out


def options(rows: DataFrame) -> DataFrame:
    """key, workers, per_worker, n_rows, out_bytes, rates, hard_cap -> up to three worker counts each, dominated ones gone.

    An option goes if another is no slower and no dearer; the planned one stays.
    """
    step = F.greatest(F.lit(1), F.bround(F.col("workers") * 0.5).cast("int"))
    counts = F.array_distinct(F.array(F.greatest(F.lit(1), F.col("workers") - step), F.col("workers"), F.least(F.col("hard_cap"), F.col("workers") + step)))
    every = rows.withColumn("planned", F.col("workers")).withColumn("workers", F.explode(counts))
    every = costs(every.withColumn("seconds", F.col("n_rows") / (F.col("per_worker") * F.col("workers"))))
    a, b = every.alias("a"), every.alias("b")
    worse = (F.col("a.key") == F.col("b.key")) & (F.col("a.workers") != F.col("b.workers")) & (F.col("b.seconds") <= F.col("a.seconds")) & (F.col("b.total") <= F.col("a.total")) & (F.col("a.workers") != F.col("a.planned"))
    return a.join(b, worse, "left_anti").withColumn("is_planned", F.col("workers") == F.col("planned"))


# Benchmarks.


def probe_rows(rows: Column) -> Column:
    return F.greatest(F.lit(50_000), F.least(F.lit(100_000), _int(rows * 0.02)))


def probe_ranges(rows: DataFrame) -> DataFrame:
    """pk_min, pk_max, size -> low, mid and high ranges (low and high, if the table has room for no more), both ends in."""
    c = F.col
    span, size = c("pk_max") - c("pk_min"), c("size")
    third = F.floor(span / 3)
    mid = F.greatest(c("pk_min") + size + 1, c("pk_min") + third + F.floor(third / 2) - F.floor(size / 2))
    high = F.greatest(mid + size + 1, c("pk_max") - size)
    short = F.greatest(c("pk_min") + size + 1, c("pk_max") - size)

    def one(label: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), start.cast("long").alias("start"), end.cast("long").alias("end"))

    two = F.array(one("low", c("pk_min"), c("pk_min") + size - 1), one("high", short, F.least(short + size - 1, c("pk_max"))))
    three = F.array(one("low", c("pk_min"), c("pk_min") + size - 1), one("mid", mid, mid + size - 1), one("high", high, F.least(high + size - 1, c("pk_max"))))
    out = rows.withColumn("r", F.explode(F.when(span < 3 * size, two).otherwise(three)))
    return out.select(*rows.columns, "r.label", "r.start", "r.end")


def optimal_workers(curve: DataFrame, key: str) -> DataFrame:
    """key, workers, tp -> the least worker count within 5% of the best throughput."""
    best = F.max("tp").over(Window.partitionBy(key))
    return curve.withColumn("near", F.col("tp") >= 0.95 * best).where("near").groupBy(key).agg(F.min("workers").alias("optimal"))


def curve_shape(a: Column) -> Column:
    """plateau, increasing or non_monotonic, of throughputs by ascending worker count."""
    peak = F.array_position(a, F.array_max(a)).cast("int")
    held = F.forall(F.slice(a, peak + 1, F.size(a)), lambda x: x >= F.array_max(a) * 0.95)
    return F.when(F.size(a) < 2, "plateau").when(peak == F.size(a), "increasing").when(held, "plateau").when(peak > 1, "non_monotonic").otherwise("plateau")


def bench_confidence(curve: DataFrame, key: str) -> DataFrame:
    """key, workers, tp, cv -> shape, confidence, signal, unrounded."""
    rows = curve.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("workers", "tp"))), lambda x: x["tp"]).alias("a"), F.avg("cv").alias("cv"))
    shape = curve_shape(F.col("a"))
    factor = F.when(shape == "plateau", 1.0).when(shape == "increasing", 0.75).otherwise(0.7)
    top, low = F.array_max("a"), F.array_min("a")
    signal = F.when(top > 0, F.greatest(F.lit(0.15), (top - low) / top)).otherwise(0.15)
    return rows.select(key, shape.alias("shape"), (F.greatest(F.lit(0.0), 1 - F.col("cv")) * factor).alias("confidence"), signal.alias("signal"))


def bench_stale(age_days: Column, rows_then: Column, rows_now: Column) -> Column:
    return (age_days > 7) | F.coalesce(K.guarded_ratio(F.abs(rows_now - rows_then), rows_then) > 0.2, F.lit(False))


def adaptive_rule(p50_ms: Column) -> Column:
    """The latency rule of a plan: null below 1 ms; else threshold, floor, most activations and cooldown."""
    return F.when(p50_ms >= 1, F.struct((5 * p50_ms).alias("threshold_ms"), F.greatest(F.lit(50.0), 10 * p50_ms).alias("floor_ms"), F.lit(10).alias("most"), F.lit(3).alias("cooldown")))


def confidence_level(n: Column, best: Column, cv: Column, dominant: Column) -> Column:
    """high, medium or low from matches and the best score; wide throughputs and a dominant run each cost a level."""
    base = F.when((n >= 3) & (best >= 0.7), 0).when((n >= 2) & (best >= 0.5), 1).otherwise(2)
    worse = F.coalesce((cv > 0.2).cast("int"), F.lit(0)) + F.coalesce(dominant.cast("int"), F.lit(0))
    return F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.least(F.lit(2), base + worse))
