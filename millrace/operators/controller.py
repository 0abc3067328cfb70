"""The worker controller: a fold over a run history, one decision after another.

Each decision changes the worker count, which decides what later windows hold, so a
key's runs are folded in order. ``step`` is the pure rule, ``advance`` one run of the
fold, which looks back over the last ten runs; ``replay`` folds every key's runs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    least: int = 1
    most: int = 16
    window: int = 5
    step: int = 1
    magnitude: float = 0.10
    consistency: float = 0.8
    regression: float = 0.30
    noise: float = 0.01
    cold_share: float = 0.33
    escape_runs: int = 3
    escape_each: float = 0.15
    escape_total: float = 0.20
    escape_step: int = 2


@dataclass(frozen=True)
class State:
    workers: int
    previous: int = 0
    previous_mean: float = 0.0
    converged: bool = False
    holds: int = 0


RULES = Rules()


def cold_start(rules: Rules = RULES) -> State:
    return State(max(rules.least, int(rules.most * rules.cold_share)))


def change(now: float, before: float) -> float:
    return (now - before) / before if before > 0 else 0.0


def _mean(xs) -> float:
    return sum(xs) / len(xs)


def step(window: list[float], state: State, rules: Rules = RULES) -> tuple[str, str, State]:
    """(decision, reason, next state) for the throughputs, oldest first, seen at the state's worker count."""
    if not window:
        return "hold", "first run", state
    falls = [change(b, a) for a, b in zip(window, window[1:], strict=False)]
    tail = falls[-(rules.escape_runs - 1) :]
    if len(window) >= rules.escape_runs and all(f <= -rules.escape_each for f in tail) and change(window[-1], window[0]) <= -rules.escape_total:
        target = min(state.workers + rules.escape_step, rules.most)
        if target == state.workers:
            return "hold", "escape at most workers", replace(state, converged=False, holds=0)
        return "increase", "escape", State(target, state.workers, _mean(window))
    if state.converged:
        if len(window) >= rules.window and change(_mean(window[-rules.window :]), state.previous_mean) < -rules.regression:
            return "hold", "regression", replace(state, converged=False, holds=0)
        return "hold", "converged", replace(state, holds=state.holds + 1)
    if len(window) < rules.window:
        return "hold", "collecting", replace(state, holds=len(window))
    mean = _mean(window)
    settled = State(state.workers, state.previous, mean, True, len(window))
    if state.previous > 0 and state.previous != state.workers and state.previous_mean > 0:
        if change(mean, state.previous_mean) < -rules.magnitude:
            return ("decrease" if state.workers > state.previous else "increase"), "revert", State(state.previous, state.workers, mean)
        return "hold", "accepted", settled
    half = len(window) // 2
    drift = change(_mean(window[half:]), _mean(window[:half])) if half else 0.0
    down = sum(f < -rules.noise for f in falls)
    if falls and down / len(falls) >= rules.consistency and drift < -rules.magnitude:
        target = min(state.workers + rules.step, rules.most)
        if target == state.workers:
            return "hold", "at most workers", settled
        return "increase", "drift", State(target, state.workers, mean)
    return "hold", "stable", settled


def recent(rules: Rules = RULES) -> int:
    """How many of the last runs a decision looks back over."""
    return rules.window + 5


def advance(past: deque, throughput: float, state: State, rules: Rules = RULES) -> tuple[str, str, State]:
    """The decision after one more run; past holds (workers, throughput) of the last runs, as many as recent() says."""
    past.append((state.workers, throughput))
    while len(past) > recent(rules):
        past.popleft()
    return step([t for w, t in past if w == state.workers and t > 0][-rules.window :], state, rules)


def fold(throughputs, start: State | None = None, rules: Rules = RULES) -> list[tuple[int, str, str, int, bool]]:
    """For each run: the workers it used, the decision after it, why, the next workers, converged."""
    state, past, out = start or cold_start(rules), deque(), []
    for tp in throughputs:
        at = state.workers
        decision, reason, state = advance(past, tp, state, rules)
        out.append((at, decision, reason, state.workers, state.converged))
    return out


def replay(runs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """runs (object, run_id, start_time, throughput) -> run_id, object, workers, decision, reason, next_workers, converged.

    Runs are dealt by object and sorted, and each task walks over its rows: memory is one state, however long a history is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, past = None, cold_start(rules), deque()
        for batch in batches:
            ids, objects, throughputs = (batch.column(c).to_pylist() for c in ("run_id", "object", "throughput"))
            out = []
            for r, o, tp in zip(ids, objects, throughputs, strict=True):
                if o != held:
                    held, state, past = o, cold_start(rules), deque()
                at = state.workers
                decision, reason, state = advance(past, tp, state, rules)
                out.append((r, o, at, decision, reason, state.workers, state.converged))
            cols = list(zip(*out, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True)], list(_KINDS))

    dealt = runs.select("object", "run_id", "start_time", "throughput").repartition("object").sortWithinPartitions("object", "start_time", "run_id")
    rows = dealt.select(F.col("run_id").cast("long").alias("run_id"), F.col("object").cast("long").alias("object"), F.coalesce(F.col("throughput").cast("double"), F.lit(0.0)).alias("throughput"))
    return rows.mapInArrow(run, "run_id long, object long, workers int, decision string, reason string, next_workers int, converged boolean")


_KINDS = {"run_id": pa.int64(), "object": pa.int64(), "workers": pa.int32(), "decision": pa.string(), "reason": pa.string(), "next_workers": pa.int32(), "converged": pa.bool_()}
