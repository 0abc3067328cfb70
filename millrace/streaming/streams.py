"""Streams of rows and of runs (extensions): incremental files, time windows, per-key baselines and decisions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import controller
from millrace.plans.api import judge


def files(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come: incremental extraction whose mark is the stream's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def windowed(rows: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per time window and key; a window is final once the watermark passes it."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("window.start").alias("time_start"), F.col("window.end").alias("time_end"), *keys, "n_rows")


def _fold(make, schema: str, state_schema: str, rows: DataFrame) -> DataFrame:
    return rows.groupBy("object").applyInPandasWithState(make, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def baselines(runs: DataFrame, n: int = 20) -> DataFrame:
    """Each run against the n before it of its object; the state of an object is n numbers."""
    import pandas as pd

    def step(key, batches: Iterator, state: GroupState):
        past = list(state.get[0]) if state.exists else []
        for pdf in batches:
            out = []
            for r in pdf.sort_values(["start_time", "run_id"]).itertuples():
                out.append((r.run_id, key[0], *judge(r.throughput, past)))
                past = [*past, float(r.throughput)][-n:]
            yield pd.DataFrame(out, columns=["run_id", "object", "is_anomaly", "z", "direction"])
        state.update((past,))

    return _fold(step, "run_id long, object long, is_anomaly boolean, z double, direction string", "past array<double>", runs)


def decisions(runs: DataFrame, rules: controller.Rules = controller.RULES) -> DataFrame:
    """The controller's decision after each run, as the batch fold gives it; an object's state is its last ten runs and the controller's."""
    import pandas as pd

    def step(key, batches: Iterator, state: GroupState):
        if state.exists:
            workers, previous, mean, converged, holds, used, seen = state.get
            at, past = controller.State(workers, previous, mean, converged, holds), deque(zip(used, seen, strict=True))
        else:
            at, past = controller.cold_start(rules), deque()
        rows = pd.concat(list(batches)).sort_values(["start_time", "run_id"])
        out = []
        for r in rows.itertuples():
            before = at.workers
            decision, reason, at = controller.advance(past, float(r.throughput), at, rules)
            out.append((r.run_id, key[0], before, decision, reason, at.workers))
        yield pd.DataFrame(out, columns=["run_id", "object", "workers", "decision", "reason", "next_workers"])
        state.update((at.workers, at.previous, at.previous_mean, at.converged, at.holds, [w for w, _ in past], [t for _, t in past]))

    return _fold(step, "run_id long, object long, workers int, decision string, reason string, next_workers int", "workers int, previous int, mean double, converged boolean, holds int, used array<int>, past array<double>", runs)
