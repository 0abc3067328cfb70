"""The engine's front: profile, plan, execute, explain, replay, inspect, history, diagnose, benchmark.

One execute path records runs, chunks, workers, deviations and the controller's
state, so every run can be learned from and replayed. Chunks are Spark jobs
sent from a pool of ``workers`` driver threads; each is one partition of the
source, and a failed one is tried again with pauses.
"""

from __future__ import annotations

import json
import math
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from statistics import fmean, pstdev
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions import kernels as K
from millrace.operators import chunking, controller, decisions, profile, similarity
from millrace.operators.backoff import Pacer, Rule
from millrace.operators.execution import rule_confidence
from millrace.plans.model import Chunk, CostRates, Intent, NotRecommended, Plan, RuntimeContext, canonical_json, fingerprint, load_plan, run_id
from millrace.plans.state import Store
from millrace.sources import sinks
from millrace.sources.connectors import Connector, connect

RETRIES, LONGEST_PAUSE = 3, 30.0


@dataclass(frozen=True)
class Planned:
    plan: Plan
    origin: str
    verdict: str
    advisories: list[dict[str, Any]]
    cost: dict[str, float] | None
    options: list[dict[str, Any]]
    constrained: bool


@dataclass(frozen=True)
class Result:
    run_id: str
    status: str
    rows: int
    seconds: float
    throughput: float
    effective_workers: float
    chunks: list[dict[str, Any]]
    anomaly: dict[str, Any] = field(default_factory=dict)
    decision: str = ""
    next_workers: int = 0


class Engine:
    def __init__(self, spark: SparkSession, store: str, sleep=time.sleep):
        self.spark, self.store, self.sleep = spark, Store(spark, store), sleep

    # Profile and plan.

    def connector(self, intent: Intent) -> Connector:
        return connect(self.spark, intent.source_type, intent.source_config, intent.object_name, intent.key)

    def profile(self, intent: Intent, max_connections: int | None = None, active: int = 0) -> dict[str, Any]:
        """Metadata, bucket skew, latency and recommendations of the intent's table, saved in the store."""
        source = self.connector(intent)
        meta = source.metadata()
        numeric = meta["pk_min"] is not None and isinstance(meta["pk_min"], (int, float)) and not isinstance(meta["pk_min"], bool)
        cv = profile.key_cv(source.read(), intent.key).first()[0] if intent.key and numeric else 0.0
        there = source.connections() if max_connections is None else None
        most, active = there or (max_connections or self.spark.sparkContext.defaultParallelism, active)
        row = self.spark.createDataFrame([(meta["n_rows"], meta["size"], meta["pk_min"] is not None, float(cv or 0.0), most, active)], "rows long, size long, has_key boolean, pk_cv double, max_conn int, active_conn int")
        told = profile.recommend(row).first().asDict()
        out = meta | {k: told[k] for k in ("avg_row_bytes", "safe_conn", "strategy", "scheduling", "workers")} | {"pk_cv": round(float(cv or 0.0), 3), "numeric_key": numeric, "latency": source.latency(), "profiled_at": _now()}
        self.store.save_profile(intent.source_type, intent.object_name, out)
        return out

    def plan(self, intent: Intent, context: RuntimeContext | None = None, rates: CostRates | None = None, profiled: dict[str, Any] | None = None, row_bytes: int | None = None) -> Planned:
        p = profiled or self.profile(intent)
        width = row_bytes or p["avg_row_bytes"] or 100
        base, origin = self._base_workers(intent, p)
        ctx = context.to_dict() if context else {}
        schema = "base int, per_worker_mb double, max_connections int, concurrent int, max_memory_mb int, network string, load string, maintenance boolean, priority string"
        row = self.spark.createDataFrame([(base, 256.0 if "max_memory_mb" in ctx else 0.0, *(ctx.get(k) for k in ("max_connections", "concurrent", "max_memory_mb", "network", "load", "maintenance", "priority")))], schema)
        workers = decisions.waterfall(row).first()["workers"]
        chunks = self._chunks(intent, p, max(1, workers), width)
        tp = self._expected(intent, p, max(1, workers), width)
        seconds = round(p["n_rows"] / max(tp, 1.0), 1)
        rule = self.spark.range(1).select(decisions.adaptive_rule(F.lit(float(p["latency"]["p50_ms"]))).alias("r")).first()["r"]
        plan = Plan(
            intent.hash(), intent.object_name, intent.key, "range_chunking" if len(chunks) > 1 else "single_pass", tuple(chunks), max(1, workers), (1, min(16, p["safe_conn"] * 2)), p["scheduling"], p["n_rows"], p["n_rows"] * width, round(tp, 6), seconds,
            {"type": intent.target_type, "format": "csv" if intent.target_type == "csv" else "parquet", "pattern": "{object}_{chunk_id}.{format}"}, rule.asDict() if rule else None, fingerprint({"columns": p["columns"]}),
        )
        found, verdict = self._verdict(plan, workers, ctx)
        cost, options = self._costs(plan, rates)
        return Planned(plan, origin, verdict, found, cost, options, bool(ctx))

    def _base_workers(self, intent: Intent, p: dict[str, Any]) -> tuple[int, str]:
        key = {"source": intent.source_type, "object": intent.object_name}
        ctl, bench = self.store.one("controller", **key), self.store.one("benchmarks", **key)
        if bench:
            age = (datetime.now(timezone.utc) - datetime.fromisoformat(bench["benchmarked_at"])).total_seconds() / 86400
            if self.spark.range(1).select(decisions.bench_stale(F.lit(age), F.lit(bench["n_rows"]), F.lit(p["n_rows"]))).first()[0]:
                bench = None
        b, c = bench or {}, ctl or {}
        row = (b.get("confidence"), b.get("signal"), b.get("optimal"), c.get("previous_mean") if c.get("previous_mean") else (1.0 if c else None), c.get("workers"), p["workers"], p["safe_conn"], os.cpu_count() or 1, intent.constraints.max_workers)
        schema = "bench_conf double, bench_signal double, bench_workers int, ctl_throughput double, ctl_workers int, prof_workers int, safe int, cores int, cap int"
        out = decisions.base_workers(self.spark.createDataFrame([row], schema)).first()
        return out["workers"], out["origin"]

    def _chunks(self, intent: Intent, p: dict[str, Any], workers: int, width: int) -> list[Chunk]:
        if p["strategy"] == "single_pass" or not p["numeric_key"] or p["pk_max"] <= p["pk_min"]:
            return [Chunk("000", "full_table", est_rows=p["n_rows"], est_bytes=p["n_rows"] * width)]
        stats = self.spark.createDataFrame([(p["n_rows"], int(p["pk_min"]), int(p["pk_max"]))], "n_rows long, pk_min long, pk_max long")
        rows = chunking.range_chunks(stats, workers, width).orderBy("chunk")
        if p["scheduling"] == "work_stealing":  # counted rows, so that the largest can go first
            rows = chunking.counted(self.connector(intent).read(), intent.key, rows.drop("n_rows")).orderBy("chunk")
        return [Chunk(f"{r['chunk']:03d}", "range", r["lo"], r["hi"], r.asDict().get("n_rows", r["est_rows"]), r["est_bytes"]) for r in rows.collect()]

    def context(self, p: dict[str, Any], active: int = 0, most: int = 0) -> dict[str, Any]:
        """The circumstances of a run as they are now; what can't be told is neutral."""
        try:
            load = min(2.0, max(0.0, os.getloadavg()[0] / (os.cpu_count() or 1)))
        except OSError:
            load = None
        classes = self.spark.range(1).select(K.source_load(F.lit(active), F.lit(most)).alias("s"), K.network_quality(F.lit(float(p["latency"]["p50_ms"]))).alias("n")).first()
        return {"schema_version": 1, "source_load": classes["s"], "concurrent": self.store.running(), "time_band": datetime.now(timezone.utc).hour // 4, "system_load": load, "network": classes["n"], "row_estimate": p["n_rows"]}

    def estimate(self, intent: Intent, p: dict[str, Any]) -> dict[str, Any]:
        """Throughput from the runs under like circumstances and from all recent runs."""
        shape = "schema_version int, source_load string, concurrent int, time_band int, system_load double, network string, row_estimate long"
        now = self.spark.createDataFrame([tuple(self.context(p).values())], shape)
        rows = self.store.with_context(intent.source_type, intent.object_name).where((F.col("throughput") > 0) & (F.lower("status") == "success"))
        age = K.age_days(F.current_timestamp(), F.try_to_timestamp("start_time"))
        then = rows.select("run_id", "throughput", age.alias("age_days"), F.from_json("context_json", shape).alias("c")).select("run_id", "throughput", "age_days", "c.*")
        scored = similarity.score_runs(now, then.withColumn("has_context", F.lit(True)).withColumn("is_benchmark", F.lit(False)))
        past = [(i, float(t), True) for i, t in enumerate(self.store.throughputs(intent.source_type, intent.object_name))]
        return similarity.estimate(scored, self.spark.createDataFrame(past, "seq long, throughput double, has_context boolean")).first().asDict()

    def _expected(self, intent: Intent, p: dict[str, Any], workers: int, width: int) -> float:
        past = self.store.throughputs(intent.source_type, intent.object_name)
        if past and not self.store.with_context(intent.source_type, intent.object_name, 1).isEmpty():
            return float(self.estimate(intent, p)["value"])
        if past:
            smooth = past[0]
            for x in past[1:]:
                smooth = 0.3 * x + 0.7 * smooth
            return smooth
        return float(self.spark.range(1).select(decisions.fallback_throughput(F.lit(float(p["latency"]["p50_ms"])), F.lit(width), F.lit(workers))).first()[0])

    def _verdict(self, plan: Plan, workers: int, ctx: dict[str, Any]) -> tuple[list[dict[str, Any]], str]:
        schema = "id int, workers int, est_minutes double, out_bytes long, target_minutes int, window_minutes int, disk_gb double, egress_mb double"
        limits = [ctx.get("target_minutes"), ctx.get("window_minutes"), *(None if ctx.get(k) is None else float(ctx[k]) for k in ("disk_gb", "egress_mb"))]
        row = self.spark.createDataFrame([(1, workers, plan.est_seconds / 60, plan.est_bytes, *limits)], schema)
        told = decisions.advisories(row).select("id", "field", "severity", "rank")
        verdict = decisions.verdicts(row.select("id", "workers").join(told, "id", "left"), "id").first()["verdict"]
        return [r.asDict() for r in told.orderBy("rank", "field").select("field", "severity").collect()], verdict

    def _costs(self, plan: Plan, rates: CostRates | None) -> tuple[dict[str, float] | None, list[dict[str, Any]]]:
        if rates is None or rates.is_zero or plan.est_throughput <= 0 or plan.est_rows <= 0:
            return None, []
        schema = "key int, workers int, per_worker double, n_rows long, out_bytes long, compute_rate double, egress_rate double, connection_rate double, hard_cap int"
        row = (1, plan.workers, plan.est_throughput / plan.workers, plan.est_rows, plan.est_bytes, rates.compute_rate, rates.egress_rate, rates.connection_rate, plan.worker_bounds[1])
        every = [r.asDict() for r in decisions.options(self.spark.createDataFrame([row], schema)).orderBy("workers").select("workers", "seconds", "compute", "egress", "connections", "total", "is_planned").collect()]
        own = next(o for o in every if o["is_planned"])
        return {k: round(own[k], 4) for k in ("compute", "egress", "connections", "total")}, every

    # Execution.

    def execute(self, intent: Intent, planned: Planned, force: bool = False, replay_of: str | None = None) -> Result:
        if planned.verdict == "not_recommended" and not force:
            raise NotRecommended("the verdict is not_recommended; force runs it all the same")
        plan, rid, began = planned.plan, run_id(), time.time()
        start = _now()
        folder = sinks.target_path(intent.target_type, intent.target_config or {"path": "./output"})
        if "://" not in folder and not folder.startswith("file:"):
            os.makedirs(folder, exist_ok=True)
            sinks.check_space(folder, plan.est_bytes)
        body = canonical_json(plan.to_dict())
        self.store.append("runs", {"run_id": rid, "plan_id": plan.plan_id, "intent_hash": plan.intent_hash, "source": intent.source_type, "object": intent.object_name, "strategy": plan.strategy, "workers": plan.workers, "start_time": start, "status": "running", "context_json": json.dumps(self.context({"n_rows": plan.est_rows, "latency": {"p50_ms": plan.rule["threshold_ms"] / 5 if plan.rule else 0.5}})), "plan_json": body, "fingerprint": fingerprint(json.loads(body)), "replay_of": replay_of, "constrained": planned.constrained})
        source = self.connector(intent)

        rule = Rule(**{k: plan.rule[k] for k in ("threshold_ms", "floor_ms", "most", "cooldown") if k in plan.rule}) if plan.rule else None
        options = {k: v for k, v in intent.target_config.items() if k in ("compression", "sep", "header", "null_value", "encoding", "partition_by", "max_bytes", "row_bytes")}
        for key, value in sinks.upload_settings(intent.target_type, intent.target_config).items():
            self.spark.sparkContext._jsc.hadoopConfiguration().set(key, value)
        mine, numbers = threading.local(), iter(range(plan.workers))

        def one(chunk: Chunk) -> dict[str, Any]:
            if not hasattr(mine, "number"):
                mine.number, mine.pacer = next(numbers), Pacer(rule) if rule else None
            rows = source.read(snapshot=True)
            if chunk.kind == "range":
                i = plan.chunks.index(chunk)
                if i > 0:
                    rows = rows.where(F.col(plan.key) >= F.lit(chunk.lo))
                if i < len(plan.chunks) - 1:  # the first takes rows without a key, too
                    low = F.col(plan.key) < F.lit(chunk.hi)
                    rows = rows.where(low | F.col(plan.key).isNull()) if i == 0 else rows.where(low)
            if intent.mode == "incremental" and intent.incremental_value is not None:
                rows = rows.where(F.col(intent.incremental_key) > F.lit(intent.incremental_value))
            name = sinks.file_name(plan.output["pattern"], plan.object_name, chunk.chunk_id, plan.output["format"])
            files = max(1, math.ceil((chunk.est_bytes or 0) / sinks.FILE_BYTES))
            t, fault, told = time.time(), None, None
            for attempt in range(RETRIES + 1):
                try:
                    told = sinks.write_chunk(rows, folder, name, plan.output["format"], files, **options)
                    break
                except Exception as e:  # any failure of a chunk is tried again and then told
                    fault = str(e)[:300]
                    if attempt < RETRIES:
                        self.sleep(min(2.0**attempt, LONGEST_PAUSE))
            took = time.time() - t
            out = {"chunk_id": chunk.chunk_id, "worker_id": mine.number, "status": "success" if told else "failed", "rows": told.rows if told else 0, "bytes": chunk.est_bytes or 0, "duration_seconds": took, "query_ms": 0.0}
            out |= {"output_path": told.paths[0] if told and told.paths else None, "paths": list(told.paths) if told else [], "error": None if told else fault}
            if rule:  # what the source takes for one row now; pauses aren't part of a chunk's time
                asked = time.perf_counter()
                rows.limit(1).collect()
                out["query_ms"] = (time.perf_counter() - asked) * 1000
                if wait := mine.pacer.pause(out["query_ms"], told is not None):
                    self.sleep(wait)
            return out

        with ThreadPoolExecutor(plan.workers) as pool:
            done = list(pool.map(one, plan.dispatch()))
        seconds = max(time.time() - began, 1e-9)
        ok = [c for c in done if c["status"] == "success"]
        rows, busy = sum(c["rows"] for c in ok), sum(c["duration_seconds"] for c in ok)
        status = "success" if len(ok) == len(done) else "failed"
        effective = max(1.0, min(float(plan.workers), busy / seconds)) if ok else float(plan.workers)
        breaches = sum(rule.breached(c["query_ms"]) for c in ok) if rule else 0
        confidence = self.spark.createDataFrame([(breaches, len(done))], "activations long, chunks long").transform(rule_confidence).first()["confidence"] if breaches else "full"
        before = self.store.recent(intent.source_type, intent.object_name, 2)
        self.store.append("chunks", *({"run_id": rid, **{k: c[k] for k in ("chunk_id", "worker_id", "status", "rows", "bytes", "duration_seconds", "output_path", "error")}} for c in done))
        per_worker: dict[int, list] = {}
        for c in done:
            per_worker.setdefault(c["worker_id"], []).append(c)
        share = {w: min(100.0, sum(c["duration_seconds"] for c in cs) / seconds * 100) for w, cs in per_worker.items()}
        self.store.append("workers", *({"run_id": rid, "worker_id": w, "chunks": len(cs), "rows": sum(c["rows"] for c in cs), "bytes": sum(c["bytes"] for c in cs), "busy_pct": share[w], "idle_pct": 100.0 - share[w]} for w, cs in sorted(per_worker.items())))
        self.store.append("runs", {"run_id": rid, "end_time": _now(), "status": status, "effective_workers": effective, "total_rows": rows, "total_bytes": plan.est_bytes, "throughput": rows / seconds, "duration_seconds": seconds, "confidence": confidence})
        if ok:
            self.store.append("heuristics", {"source": intent.source_type, "object": intent.object_name, "metric": "throughput_baseline", "value": rows / seconds, "confidence": 1.0 if confidence == "full" else 0.5})
            sinks.write_manifest(self.spark, folder, rid, "complete" if status == "success" else "partial", plan.output["format"], plan.schema_hash, [p for c in ok for p in c["paths"]] or None)
        anomaly, decision, then = self._learn(intent, plan, rid, rows / seconds, status, [c["duration_seconds"] for c in ok], before)
        return Result(rid, status, rows, seconds, rows / seconds, effective, done, anomaly, decision, then)

    def _learn(self, intent: Intent, plan: Plan, rid: str, tp: float, status: str, durations: list[float], before: list[dict]) -> tuple[dict, str, int]:
        """Anomaly and deviation of the run, and the controller's next worker count."""
        source, obj = intent.source_type, intent.object_name
        past = self.store.throughputs(source, obj, 21)
        base = past[:-1] if past and status == "success" else past
        odd, z, direction = judge(tp, base[-20:])
        last = next((r for r in before if r["run_id"] != rid), None)
        moved = controller.change(tp, last["throughput"]) if last and last["throughput"] else 0.0
        category = "stable"
        if last and last["workers"] and plan.workers != last["workers"] and abs(moved) > 0.05:
            category = "under_parallel" if (plan.workers > last["workers"]) == (moved > 0) else "over_parallel"
        spread = pstdev(durations) / fmean(durations) if len(durations) > 1 and fmean(durations) > 0 else 0.0
        self.store.append("deviations", {"run_id": rid, "category": category, "change": moved, "chunk_cv": spread, "is_anomaly": odd, "z": z, "direction": direction})
        held = self.store.one("controller", source=source, object=obj)
        state = controller.State(held["workers"], held["previous"], held["previous_mean"], held["converged"], held["holds"]) if held else controller.State(plan.workers)
        window = [r["throughput"] for r in reversed(self.store.recent(source, obj, controller.RULES.window + 5)) if r["workers"] == state.workers and (r["throughput"] or 0) > 0][-controller.RULES.window :]
        decision, reason, state = controller.step(window, state)
        self.store.append("controller", {"source": source, "object": obj, **asdict(state)})
        return {"is_anomaly": odd, "z": z, "direction": direction}, f"{decision}: {reason}", state.workers

    def replay(self, intent: Intent, run: str, force: bool = False) -> Result:
        """The recorded plan once more, unchanged; run is an id or its beginning."""
        row = self.store.find_run(run)
        if row is None or not row["plan_json"]:
            raise KeyError(f"no recorded plan for {run!r}")
        plan = load_plan(row["plan_json"], row["fingerprint"], force)
        return self.execute(intent, Planned(plan, "replay", "safe", [], None, [], False), force=True, replay_of=row["run_id"])

    # Reading back.

    def explain(self, run: str) -> dict[str, Any]:
        row = self.store.find_run(run)
        if row is None:
            raise KeyError(f"no run {run!r}")
        own = F.col("run_id") == row["run_id"]
        chunks = [r.asDict() for r in self.store.latest("chunks").where(own).orderBy("chunk_id").collect()]
        workers = [r.asDict() for r in self.store.latest("workers").where(own).orderBy("worker_id").collect()]
        return {"run": row, "chunks": chunks, "workers": workers, "deviation": self.store.one("deviations", run_id=row["run_id"])}

    def history(self, source: str, obj: str, n: int = 10) -> list[dict[str, Any]]:
        rows = self.store.recent(source, obj, n)
        causes = {r["run_id"]: r["category"] for r in self.store.latest("deviations").where(F.col("run_id").isin([r["run_id"] for r in rows])).collect()} if rows else {}
        return [{k: r[k] for k in ("run_id", "start_time", "status", "workers", "total_rows", "throughput")} | {"cause": causes.get(r["run_id"], "-")} for r in rows]

    def diagnose(self, run: str) -> dict[str, Any]:
        """Chunk skew of a run, its fastest and slowest chunk, and up to three slow ones."""
        told = self.explain(run)
        ok = sorted((c for c in told["chunks"] if c["status"] == "success"), key=lambda c: c["duration_seconds"])
        if not ok:
            return {"run_id": told["run"]["run_id"], "skew": None, "slowest": []}
        ratio = ok[-1]["duration_seconds"] / max(ok[len(ok) // 2]["duration_seconds"], 1e-9)
        return {"run_id": told["run"]["run_id"], "ratio": ratio, "skew": "HIGH" if ratio > 3 else "MODERATE" if ratio > 1.5 else "LOW", "fastest": ok[0]["chunk_id"], "slowest": [c["chunk_id"] for c in ok[::-1][:3]] if ratio > 1.5 else [ok[-1]["chunk_id"]]}

    def metrics(self, run: str) -> dict[str, Any]:
        told = self.explain(run)
        rates = [c["rows"] / c["duration_seconds"] for c in told["chunks"] if c["status"] == "success" and c["duration_seconds"] > 0]
        return {"run_id": told["run"]["run_id"], "peak": max(rates, default=0.0), "low": min(rates, default=0.0), "effective_workers": told["run"]["effective_workers"], "workers": told["workers"]}

    def inspect(self, source: str, obj: str) -> dict[str, Any]:
        """Whether the next run can be trusted: health, trend, anomalies of the last three runs, profile age, controller."""
        rows = self.store.recent(source, obj, 5)
        if not rows:
            return {"verdict": "NEEDS ATTENTION", "note": "no runs"}
        profiled = self.store.one("profiles", source=source, object=obj)
        stale = not profiled or (datetime.now(timezone.utc) - datetime.fromisoformat(profiled["profiled_at"])).total_seconds() > 86400
        marks = self.store.latest("deviations").where(F.col("run_id").isin([r["run_id"] for r in rows[:3]]) & F.col("is_anomaly")).count()
        state = self.store.one("controller", source=source, object=obj)
        tps = [r["throughput"] for r in reversed(rows) if (r["throughput"] or 0) > 0]
        drift = (tps[-1] - tps[0]) / tps[0] * 100 if tps else 0.0
        bad = rows[0]["status"] != "success" or marks >= 2 or (len(tps) >= 3 and tps[0] >= 1000 and drift < -20)
        watch = marks > 0 or stale or not (state and state["converged"])
        return {"verdict": "DEGRADED" if bad else "NEEDS ATTENTION" if watch else "HEALTHY", "anomalies": marks, "drift_pct": drift, "profile_stale": stale, "controller": state}

    def benchmark(self, intent: Intent, most: int = 8) -> dict[str, Any] | None:
        """Counts key ranges under 1, 2, 4 and 8 tasks at a time; None for a table that a scan ends within seconds."""
        p = self.profile(intent)
        if not p["numeric_key"] or p["size"] / (25 << 20) < 12:
            return None
        return self.measure(intent, p, most)

    def measure(self, intent: Intent, p: dict[str, Any], most: int = 8) -> dict[str, Any]:
        size = self.spark.range(1).select(decisions.probe_rows(F.lit(p["n_rows"]))).first()[0]
        ranges = decisions.probe_ranges(self.spark.createDataFrame([(int(p["pk_min"]), int(p["pk_max"]), int(size))], "pk_min long, pk_max long, size long")).collect()
        df, curve = self.connector(intent).read(), []
        for w in (n for n in (1, 2, 4, 8) if n <= most):
            rates = []
            for r in ranges:
                step = max(1, (r["end"] - r["start"] + 1) // w)
                bounds = [(r["start"] + i * step, r["end"] + 1 if i == w - 1 else r["start"] + (i + 1) * step) for i in range(w)]
                count = lambda b: df.where((F.col(intent.key) >= b[0]) & (F.col(intent.key) < b[1])).count()
                count(bounds[0])
                began = time.perf_counter()
                with ThreadPoolExecutor(w) as pool:
                    n = sum(pool.map(count, bounds))
                rates.append(n / max(time.perf_counter() - began, 1e-9))
            curve.append((0, w, fmean(rates), pstdev(rates) / fmean(rates) if len(rates) > 1 and fmean(rates) > 0 else 0.0))
        rows = self.spark.createDataFrame(curve, "key int, workers int, tp double, cv double")
        out = decisions.bench_confidence(rows, "key").first().asDict() | {"optimal": decisions.optimal_workers(rows, "key").first()["optimal"], "benchmarked_at": _now(), "n_rows": p["n_rows"]}
        self.store.append("benchmarks", {"source": intent.source_type, "object": intent.object_name, **{k: out[k] for k in ("benchmarked_at", "optimal", "confidence", "signal", "shape", "n_rows")}, "result_json": json.dumps(curve)})
        return out


def judge(now: float, base: list[float]) -> tuple[bool, float, str]:
    """(anomaly, z, direction) of a throughput against those before it."""
    if len(base) < 5:
        return False, 0.0, "none"
    mean, sigma = fmean(base), pstdev(base)
    if sigma < 1e-6:
        ratio = abs(now - mean) / mean if mean > 0 else 0.0
        odd, z = ratio > 0.2, ratio / 0.2 if ratio > 0.2 else 0.0
    else:
        z = abs(now - mean) / sigma
        odd = z > 2
    return odd, z, "none" if not odd else "degradation" if now < mean else "improvement"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()
