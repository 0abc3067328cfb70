"""Streams give what the batch kernels give."""

from millrace.operators import controller, history
from millrace.streaming import streams

RUNS = "run_id long, object long, start_time timestamp, throughput double"


def _drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _input(spark, tmp_path):
    rows = spark.range(240).selectExpr("id as run_id", "id % 3 as object", "timestamp_seconds(1704067200 + id * 60) as start_time", "cast((id * 37) % 101 + 50 as double) as throughput")
    for i in range(3):
        rows.where(f"run_id >= {i * 80} and run_id < {(i + 1) * 80}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, streams.files(spark, str(tmp_path / "in"), RUNS)


def test_baselines_and_decisions(spark, tmp_path):
    rows, stream = _input(spark, tmp_path)
    got = {r.run_id: r.is_anomaly for r in _drain(spark, streams.baselines(stream), "b").collect()}
    assert got == {r.run_id: r.is_anomaly for r in history.anomalies(rows).collect()}
    made = {r.run_id: (r.workers, r.decision, r.next_workers) for r in _drain(spark, streams.decisions(stream), "d").collect()}
    assert made == {r.run_id: (r.workers, r.decision, r.next_workers) for r in controller.replay(rows).collect()} and len(made) == 240


def test_windows(spark, tmp_path):
    rows, stream = _input(spark, tmp_path)
    got = _drain(spark, streams.windowed(stream, "start_time", "1 hour", "0 seconds"), "w", "complete")
    assert sum(r.n_rows for r in got.collect()) == rows.count() and got.count() == 4
