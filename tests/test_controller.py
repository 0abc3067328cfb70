"""The controller's rule and its loop with the simulated source."""

import random
import statistics

import pytest

from millrace.operators.controller import RULES, State, cold_start, fold, replay, step
from millrace.operators.simulation import Workload


def test_cold_start_and_first_runs_hold():
    assert cold_start() == State(5)
    assert step([], State(3)) == ("hold", "first run", State(3))
    decision, reason, state = step([100.0, 101.0], State(3))
    assert (decision, reason, state.holds) == ("hold", "collecting", 2)


def test_stable_window_converges_and_regression_reopens():
    _, reason, state = step([100.0] * 5, State(4))
    assert reason == "stable" and state.converged and state.previous_mean == 100.0
    assert step([99.0] * 5, state)[1] == "converged"
    assert step([69.0] * 5, state)[1] == "regression"
    assert step([71.0] * 5, state)[1] == "converged"


def test_drift_tries_one_more_and_change_is_accepted_or_reverted():
    decision, reason, state = step([100.0, 95.0, 88.0, 82.0, 76.0], State(4))
    assert (decision, reason, state.workers, state.previous) == ("increase", "drift", 5, 4)
    assert step([90.0] * 5, state)[1] == "accepted"
    decision, reason, back = step([70.0] * 5, state)
    assert (decision, reason, back.workers) == ("decrease", "revert", 4)


def test_escape_goes_up_even_when_converged_and_stops_at_most():
    window = [100.0, 80.0, 60.0]
    assert step(window, State(4, converged=True))[2].workers == 6
    assert step(window, State(15))[2].workers == 16
    decision, reason, state = step(window, State(16, converged=True))
    assert (decision, reason, state.converged) == ("hold", "escape at most workers", False)
    assert step([100.0, 86.0, 60.0], State(4))[1] == "collecting"


def test_improvement_is_never_acted_on():
    assert step([100.0, 110.0, 120.0, 130.0, 140.0], State(4))[1] == "stable"


def _loop(seed, runs, workers=2):
    source, state, used, out = Workload(peak_workers=3, spread=0.05, seed=seed), State(workers), [], []
    for i in range(runs):
        tp = source.run(i, state.workers)["throughput"]
        used.append((state.workers, tp))
        window = [t for w, t in used if w == state.workers][-RULES.window :]
        _, _, state = step(window, state)
        out.append(state)
    return out


def test_loop_converges_and_stays():
    for seed in (42, 1, 2, 3, 4):
        states = _loop(seed, 40)
        assert any(s.converged for s in states)
    late = _loop(42, 600)
    assert sum(a.workers != b.workers for a, b in zip(late[100:], late[101:], strict=False)) <= 2
    assert all(1 <= s.workers <= 16 for s in late)


def test_fold_is_deterministic_and_bounded():
    rng = random.Random(7)
    tps = [rng.uniform(10, 1000) for _ in range(500)]
    first = fold(tps)
    assert first == fold(tps)
    assert all(1 <= r[3] <= 16 and abs(r[3] - r[0]) <= 2 for r in first)


def test_replay_equals_fold(spark):
    rows = [(o, i, i // 3, float((i * 37 + o * 11) % 200 + 1)) for o in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "object long, run_id long, start_time int, throughput double")
    got = {(r.object, r.run_id): (r.workers, r.decision, r.reason, r.next_workers, r.converged) for r in replay(df).collect()}
    for o in (1, 2):
        own = [r for r in rows if r[0] == o]
        for r, x in zip(own, fold([r[3] for r in own]), strict=True):
            assert got[o, r[1]] == x


def test_simulated_source():
    a, b = list(Workload(seed=3).history([4] * 5)), list(Workload(seed=3).history([4] * 5))
    assert a == b and len({r["throughput"] for r in a}) == 5
    curve = [Workload(peak_workers=6).mean_throughput(w) for w in range(1, 13)]
    assert max(range(12), key=curve.__getitem__) + 1 == 6
    uneven = Workload(evenness=0.3).run(1, 4, 200)["durations"]
    even = Workload(evenness=500.0).run(1, 4, 200)["durations"]
    assert max(uneven) / statistics.median(uneven) > 3 > max(even) / statistics.median(even)


def _naive(throughputs):
    """The rule as said: a decision looks at the last ten runs, and of these at the last five with the current worker count."""
    state, runs, out = cold_start(), [], []
    for tp in throughputs:
        runs.append((state.workers, tp))
        window = [t for w, t in runs[-10:] if w == state.workers and t > 0][-5:]
        at = state.workers
        decision, reason, state = step(window, state)
        out.append((at, decision, reason, state.workers, state.converged))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_fold_looks_back_over_ten_runs(seed):
    rng = random.Random(seed)
    history = [rng.choice([100.0, 90.0, 60.0, 30.0, 200.0, 0.0]) * rng.uniform(0.9, 1.1) for _ in range(80)]
    assert fold(history) == _naive(history)
