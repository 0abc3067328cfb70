"""Column kernels against exact Python twins, with generated inputs."""

import math
import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import kernels as K
from millrace.operators import chunking, decisions, profile, similarity

FAST = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
POSITIVE = st.floats(0.01, 1e6, allow_nan=False)


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in _types(values))).select(column.alias("x")).first()["x"]


def _types(values):
    kind = {int: "long", float: "double", str: "string", list: "array<double>", bool: "boolean"}
    return [(k, kind[type(v)]) for k, v in values.items()]


@FAST
@given(st.lists(POSITIVE, min_size=1, max_size=12))
def test_array_folds(spark, xs):
    smooth = xs[0]
    for x in xs[1:]:
        smooth = 0.3 * x + 0.7 * smooth
    row = spark.createDataFrame([(xs,)], "a array<double>").select(K.ewma(F.col("a")).alias("e"), K.upper_median(F.col("a")).alias("m"), K.array_cv(F.col("a")).alias("c")).first()
    assert math.isclose(row.e, smooth, rel_tol=1e-9)
    assert row.m == sorted(xs)[len(xs) // 2]
    assert math.isclose(row.c, statistics.pstdev(xs) / statistics.fmean(xs) if len(xs) > 1 else 0.0, rel_tol=1e-6, abs_tol=1e-9)


def test_empty_folds(spark):
    row = spark.createDataFrame([([],)], "a array<double>").select(K.ewma(F.col("a")).alias("e"), K.array_cv(F.col("a")).alias("c")).first()
    assert (row.e, row.c) == (0.0, 0.0)


@FAST
@given(st.integers(0, 10**7), st.integers(-(10**6), 10**6), st.integers(0, 10**7), st.integers(1, 16))
def test_chunks_are_disjoint_and_cover(spark, rows, low, span, workers):
    stats = spark.createDataFrame([(rows, low, low + span)], "n_rows long, pk_min long, pk_max long")
    got = chunking.range_chunks(stats, workers).orderBy("chunk").collect()
    n = 1 if span == 0 else min(200, max(2 * workers, rows // 500_000, 1))
    assert len(got) == n and got[0].lo == low and got[-1].hi == low + span + 1
    assert all(a.hi == b.lo for a, b in zip(got, got[1:], strict=False))
    assert [c.lo for c in got] == [round(low + i * (span / n)) for i in range(n)]


def _waterfall(base, mem, conn, conc, memory, net, load, maint, prio):
    base = max(1, base)
    if conn is not None and conc is not None and conn - conc <= 0:
        return 0
    cap = base if conn is None else min(base, conn - (conc or 0))
    if memory is not None and mem > 0:
        cap = min(cap, int(memory / mem))
    cap = max(1, cap)
    factor = {"degraded": 0.75, "poor": 0.5}.get(net, 1.0) * (0.5 if load == "high" else 1.0) * (0.5 if maint else 1.0)
    after = max(1, int(cap * max(0.25, factor)))
    final = {"low": max(1, int(after * 0.75)), "critical": min(cap, int(after * 1.25))}.get(prio, after)
    return max(1, final)


def test_waterfall_grid(spark):
    rows = [
        (base, mem, conn, conc, memory, net, load, maint, prio)
        for base in (0, 1, 5, 8)
        for mem, memory in ((0.0, 100), (30.0, 100), (30.0, None))
        for conn, conc in ((None, 3), (4, None), (4, 1), (3, 3))
        for net in (None, "good", "degraded", "poor")
        for load, maint in ((None, None), ("high", True))
        for prio in (None, "low", "critical")
    ]
    schema = "base int, per_worker_mb double, max_connections int, concurrent int, max_memory_mb int, network string, load string, maintenance boolean, priority string"
    got = [r.workers for r in decisions.waterfall(spark.createDataFrame(rows, schema)).select("workers").collect()]
    assert got == [_waterfall(*r) for r in rows]


def test_histogram_edges(spark):
    flat = spark.createDataFrame([(7,)] * 4, "k int")
    assert [(r.bucket, r.n_rows) for r in profile.histogram(flat, "k").collect()] == [(0, 4)]
    top = spark.createDataFrame([(i,) for i in range(101)] + [(None,)], "k int")
    got = profile.histogram(top, "k").orderBy("bucket").collect()
    assert [r.n_rows for r in got] == [10] * 9 + [11]
    assert profile.histogram(spark.createDataFrame([], "k int"), "k").count() == 0


def test_text_and_classes(spark):
    row = spark.range(1).select(
        K.bytes_text(F.lit(1536)).alias("a"), K.number_text(F.lit(2_500_000)).alias("b"), K.age_text(F.lit(7300)).alias("c"), K.short_id(F.lit("rx-1-2-abc")).alias("d"),
        K.age_days(F.lit("2024-01-02 00:00:00").cast("timestamp"), F.lit(None).cast("timestamp")).alias("e"), K.network_quality(F.lit(20.0)).alias("f"), K.source_load(F.lit(8), F.lit(0)).alias("g"),
    ).first()
    assert tuple(row) == ("1.5 KB", "2.5M", "2 hours ago", "abc", 30.0, "poor", "normal")


def test_weights_without_system_load():
    w = similarity.weights_without_system_load()
    assert math.isclose(sum(w.values()), 1.0) and "system_load" not in w
    assert w["source_load"] == max(w.values())


def test_cold_start_estimate(spark):
    scored = spark.createDataFrame([], "run_id long, score double, reason string, throughput double, age_days double")
    past = spark.createDataFrame([], "seq long, throughput double, has_context boolean")
    row = similarity.estimate(scored, past, fallback=123.0).first()
    assert (row.method, row.value, row.confidence) == ("cold_start", 123.0, "low")
