"""The run store: append-only Parquet tables; the latest row of a key is the key's state.

An upsert is an append and a view: ``max_by`` over the version. One writer at a
time per store; ``compact`` rewrites a table to its latest rows.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "runs": "run_id string, plan_id string, intent_hash string, source string, object string, strategy string, workers int, effective_workers double, start_time string, end_time string, status string, total_rows long, total_bytes long, throughput double, duration_seconds double, context_json string, confidence string, runtime_json string, plan_json string, fingerprint string, replay_of string, constrained boolean",
    "chunks": "run_id string, chunk_id string, worker_id int, status string, rows long, bytes long, duration_seconds double, output_path string, error string",
    "workers": "run_id string, worker_id int, chunks long, rows long, bytes long, busy_pct double, idle_pct double",
    "deviations": "run_id string, category string, change double, chunk_cv double, is_anomaly boolean, z double, direction string",
    "heuristics": "source string, object string, metric string, value double, confidence double",
    "controller": "source string, object string, workers int, previous int, previous_mean double, converged boolean, holds int",
    "profiles": "source string, object string, profiled_at string, n_rows long, pk_min string, pk_max string, pk_cv double, avg_row_bytes long, profile_json string",
    "benchmarks": "source string, object string, benchmarked_at string, optimal int, confidence double, signal double, shape string, n_rows long, result_json string",
}
KEYS = {"runs": ["run_id"], "chunks": ["run_id", "chunk_id"], "workers": ["run_id", "worker_id"], "deviations": ["run_id"], "heuristics": ["source", "object", "metric"], "controller": ["source", "object"], "profiles": ["source", "object"], "benchmarks": ["source", "object"]}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _schema(self, table: str) -> str:
        return SCHEMAS[table] + ", _version long"

    def append(self, table: str, *rows: dict) -> None:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        unknown = {k for r in rows for k in r} - set(names)
        if unknown:
            raise KeyError(f"{table} has no column {', '.join(sorted(unknown))}")
        version = time.time_ns()
        body = [tuple(r.get(n) for n in names) + (version + i,) for i, r in enumerate(rows)]
        if body:
            self.spark.createDataFrame(body, self._schema(table)).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def history(self, table: str) -> DataFrame:
        """All versions; a table without rows yet is empty."""
        path = f"{self.path}/{table}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(path)

    def latest(self, table: str) -> DataFrame:
        """The newest row of each key; a column that it leaves null keeps its last value."""
        keys = KEYS[table]
        names = [c.split()[0] for c in SCHEMAS[table].split(", ") if c.split()[0] not in keys]
        newest = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_version"))).alias(n) for n in names]
        return self.history(table).groupBy(*keys).agg(*newest)

    def compact(self, table: str) -> None:
        rows = self.latest(table).withColumn("_version", F.lit(time.time_ns())).cache()
        rows.count()
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}~")
        self.spark.read.parquet(f"{self.path}/{table}~").write.mode("overwrite").parquet(f"{self.path}/{table}")
        rows.unpersist()

    def one(self, table: str, **keys) -> dict | None:
        rows = self.latest(table)
        for k, v in keys.items():
            rows = rows.where(F.col(k) == v)
        hit = rows.limit(1).collect()
        return hit[0].asDict() if hit else None

    def recent(self, source: str, obj: str, n: int = 10) -> list[dict]:
        rows = self.latest("runs").where((F.col("source") == source) & (F.col("object") == obj))
        return [r.asDict() for r in rows.orderBy(F.desc("start_time"), F.desc("run_id")).limit(n).collect()]

    def throughputs(self, source: str, obj: str, n: int = 20, learn_only: bool = False) -> list[float]:
        """Of the last n successful runs, oldest first; low-confidence runs don't count, nor with learn_only those a context held back."""
        rows = self.latest("runs").where((F.col("source") == source) & (F.col("object") == obj) & (F.lower("status") == "success") & (F.col("throughput") > 0) & (F.coalesce("confidence", F.lit("full")) != "low"))
        if learn_only:
            rows = rows.where(~F.coalesce("constrained", F.lit(False)))
        return [r[0] for r in rows.orderBy(F.desc("start_time"), F.desc("run_id")).limit(n).select("throughput").collect()][::-1]

    def with_context(self, source: str, obj: str, n: int = 50) -> DataFrame:
        rows = self.latest("runs").where((F.col("source") == source) & (F.col("object") == obj) & F.get_json_object("context_json", "$.schema_version").isNotNull())
        return rows.orderBy(F.desc("start_time"), F.desc("run_id")).limit(n)

    def running(self, but: str | None = None) -> int:
        rows = self.latest("runs").where(F.lower("status") == "running")
        return min(20, (rows if but is None else rows.where(F.col("run_id") != but)).count())

    def find_run(self, prefix: str) -> dict | None:
        """By id, else the latest whose id starts so."""
        hit = self.latest("runs").where(F.col("run_id").startswith(prefix)).orderBy((F.col("run_id") == prefix).desc(), F.desc("start_time")).limit(1).collect()
        return hit[0].asDict() if hit else None

    def save_profile(self, source: str, obj: str, profile: dict) -> None:
        keep = {k: profile.get(k) for k in ("profiled_at", "n_rows", "pk_cv", "avg_row_bytes")}
        self.append("profiles", {"source": source, "object": obj, "pk_min": str(profile.get("pk_min")), "pk_max": str(profile.get("pk_max")), "profile_json": json.dumps(profile, default=str), **keep})
