"""Plans, the store, sinks, connectors, the front and the command line."""

import json
import hashlib
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.plans.api import Engine, judge
from millrace.plans.model import Chunk, Constraints, CostRates, Intent, NotRecommended, Plan, PlanCorruption, RuntimeContext, UnsupportedPlan, ValidationError, canonical_json, fingerprint, load_plan
from millrace.operators.backoff import Rule, fold, replay
from millrace.plans import text
from millrace.plans.state import Store
from millrace.sources import scans, sinks
from millrace.sources.connectors import connect


def _plan(**changes):
    base = {"intent_hash": "h", "object_name": "t", "key": "k", "strategy": "range_chunking", "chunks": (Chunk("000", "range", 1, 5, 4), Chunk("001", "range", 5, 10, 9)), "workers": 2, "est_throughput": 200000.123456789}
    return Plan(**(base | changes))


def test_intent_rules_and_hash():
    with pytest.raises(ValidationError, match="source_type.*incremental"):
        Intent("oracle", {}, "t", mode="incremental")
    with pytest.raises(ValidationError):
        Intent("mysql", {}, "t", constraints=Constraints(max_workers=65))
    a, b = (Intent("mysql", {"host": "x", "password": p}, "t") for p in ("1", "2"))
    assert a.hash() == b.hash() and a.object_key == "mysql::t"
    assert a.hash() != Intent("mysql", {"host": "y"}, "t").hash()


def test_context_reports_every_fault():
    with pytest.raises(ValidationError) as e:
        RuntimeContext.build({"load": "extreme", "max_connections": True, "colour": 1, "disk_gb": 0})
    assert all(x in str(e.value) for x in ("load", "max_connections", "colour", "disk_gb"))
    assert RuntimeContext.build({}) is None
    assert RuntimeContext.build({"load": "low", "priority": "low"}, priority="critical").to_dict() == {"load": "low", "priority": "critical"}


def test_plan_rules_and_round_trip():
    for bad in ({"workers": 0}, {"chunks": ()}, {"worker_bounds": (4, 2)}, {"strategy": "x"}):
        with pytest.raises(ValidationError):
            _plan(**bad)
    p = _plan()
    text = canonical_json(p.to_dict())
    back = load_plan(text, fingerprint(json.loads(text)))
    assert back.same_work() == p.same_work() and back.chunks == p.chunks
    assert _plan().fingerprint() != p.fingerprint() and _plan().same_work() == p.same_work()
    with pytest.raises(PlanCorruption):
        load_plan(text.replace('"workers":2', '"workers":3'), p.fingerprint())
    old = canonical_json(p.to_dict() | {"plan_version": "0.9"})
    with pytest.raises(UnsupportedPlan):
        load_plan(old, fingerprint(json.loads(old)))
    assert load_plan(old, fingerprint(json.loads(old)), force=True).plan_version == "0.9"
    assert [c.chunk_id for c in _plan(scheduling="work_stealing").dispatch()] == ["001", "000"]


def test_canonical_json_rules():
    assert canonical_json({"b": 1.23456789, "a": float("nan"), "c": [2, 1]}) == '{"a":0.0,"b":1.234568,"c":[2,1]}'


def test_backoff_needs_both_limits_and_rests():
    rule = Rule(threshold_ms=5.0, floor_ms=50.0)
    assert fold([10.0, 49.0] * 5, rule) == [0.0] * 10
    assert fold([60.0] * 10, rule) == [0, 0, 0, 1, 0, 0, 0, 2, 0, 0]
    assert sum(p > 0 for p in fold([60.0] * 100, rule)) == 10 and max(fold([60.0] * 100, rule)) == 30.0


def test_backoff_replay_is_the_fold(spark):
    rng = random.Random(3)
    rule = Rule(threshold_ms=5.0, floor_ms=50.0)
    runs = {r: [rng.choice([10.0, 60.0, 80.0]) for _ in range(rng.randint(1, 60))] for r in range(40)}
    rows = [(r, f"{i:04d}", ms) for r, xs in runs.items() for i, ms in enumerate(xs)]
    rng.shuffle(rows)
    got = {r.run_id: r for r in replay(spark.createDataFrame(rows, "run_id long, seq string, query_ms double"), rule).collect()}
    for r, xs in runs.items():
        pauses = fold(xs, rule)
        assert (got[r].chunks, got[r].activations, got[r].paused_s, got[r].breaches) == (len(xs), sum(p > 0 for p in pauses), sum(pauses), sum(x > 50 for x in xs))


@pytest.mark.parametrize("options", [{}, {"partition_by": "k"}, {"max_bytes": 1_000_000, "row_bytes": 10_000}])
def test_no_row_of_a_chunk_is_lost(spark, tmp_path, options):
    df = spark.range(1000).selectExpr("id", "id % 4 as k", "repeat('x', 50) as pad").repartition(6)
    folder = str(tmp_path / "c")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        sinks.write_chunk(df.limit(700), folder, "t_000.parquet", **options)  # an earlier try that left more or other files
        told = sinks.write_chunk(df, folder, "t_000.parquet", files=2, **options)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert told.rows == 1000 and len(told.paths) >= 10
    back = spark.read.parquet(folder)
    assert back.count() == 1000 and back.agg({"id": "sum"}).first()[0] == 499_500
    assert not [f for f in os.listdir(folder) if f.startswith("._")]
    sums = {r.path.rsplit("/", 1)[-1]: r for r in sinks.inventory(spark, folder).collect()}
    for path in glob.glob(folder + "/**/*.parquet", recursive=True):
        own = sums[os.path.basename(path)] if not options.get("partition_by") else None
        with open(path, "rb") as f:
            assert own is None or own.sha256 == hashlib.sha256(f.read()).hexdigest()
    assert sinks.inventory(spark, folder).agg({"n_rows": "sum"}).first()[0] == 1000


def test_reports():
    assert text.reasons(1, 0.5, None, True) == ["sparse_evidence", "weak_match", "dominant_match"]
    assert text.exclusions([(f"r{i}", "x") for i in range(5)]).endswith("and 2 more")
    assert text.duration(90) == "1.5 min" and text.verdict("safe") == "SAFE TO RUN"


def test_judge_branches():
    assert judge(1, [1] * 4) == (False, 0.0, "none")
    assert judge(79, [100.0] * 6)[0] and not judge(81, [100.0] * 6)[0]
    base = [90.0, 110.0] * 5
    assert judge(120.0, base) == (False, 2.0, "none") and judge(120.1, base)[2] == "improvement"


def test_range_predicates_cover_everything(spark):
    df = spark.createDataFrame([(i,) for i in range(-5, 30)] + [(None,)], "k int")
    bounds = [(0, 10), (10, 20), (20, 25)]
    parts = [df.where(p.replace('"', "`")) for p in scans.range_predicates("k", bounds)]
    assert sum(p.count() for p in parts) == df.count()
    union = parts[0].union(parts[1]).union(parts[2])
    assert union.exceptAll(df).count() == 0 and df.exceptAll(union).count() == 0


def test_offset_chunks_are_the_table(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    rows = [r.k for i in range(0, 100, 30) for r in scans.offset_chunk(df, "k", i, 30).collect()]
    assert sorted(rows) == list(range(100))


def test_store_upserts(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.one("controller", source="a", object="b") is None
    s.append("controller", {"source": "a", "object": "b", "workers": 3, "converged": False})
    s.append("controller", {"source": "a", "object": "b", "workers": 4, "converged": True})
    assert s.one("controller", source="a", object="b")["workers"] == 4
    s.append("runs", *({"run_id": f"rx-{i}", "source": "a", "object": "b", "start_time": f"2024-01-0{i}", "status": "success" if i != 3 else "failed", "throughput": float(i), "confidence": "low" if i == 4 else "full", "constrained": i == 2} for i in range(1, 7)))
    assert s.throughputs("a", "b") == [1.0, 2.0, 5.0, 6.0] and s.throughputs("a", "b", learn_only=True) == [1.0, 5.0, 6.0]
    assert [r["run_id"] for r in s.recent("a", "b", 2)] == ["rx-6", "rx-5"]
    assert s.find_run("rx-")["run_id"] == "rx-6" and s.find_run("rx-2")["run_id"] == "rx-2" and s.find_run("q") is None
    s.append("runs", {"run_id": "rx-6", "status": "running"})
    assert s.running() == 1 and s.running("rx-6") == 0 and s.one("runs", run_id="rx-6")["throughput"] == 6.0
    s.compact("controller")
    assert s.history("controller").count() == 1 and s.one("controller", source="a", object="b")["converged"]
    with pytest.raises(KeyError):
        s.append("runs", {"colour": 1})


def test_sinks(spark, tmp_path):
    df = spark.range(1000).withColumn("s", F.concat(F.lit("v"), "id"))
    folder = str(tmp_path / "out")
    name = sinks.file_name("{object}_{chunk_id}.{format}", "t", "000", "parquet")
    sinks.write_chunk(df, folder, name)
    sinks.write_chunk(df, folder, name)
    assert spark.read.parquet(folder).count() == 1000
    body = sinks.write_manifest(spark, folder, "r", "complete")
    assert (body["file_count"], body["total_rows"]) == (1, 1000) and sinks.verify_manifest(spark, folder) == []
    sinks.write_chunk(df.limit(3), folder, name)
    assert "changed" in sinks.verify_manifest(spark, folder)[0]
    sinks.write(df, str(tmp_path / "rot"), max_bytes=1_000_000, row_bytes=10_000.0)
    assert sinks.inventory(spark, str(tmp_path / "rot")).count() >= 10
    with pytest.raises(ValueError):
        sinks.rows_per_segment(999_999, 10)
    nulls = spark.createDataFrame([(1, None), (2, "a|b")], "a int, b string")
    sinks.write(nulls, str(tmp_path / "csv"), "csv", sep="|", null_value="NULL")
    assert spark.read.option("header", True).option("sep", "|").option("nullValue", "NULL").csv(str(tmp_path / "csv")).where("b is null").count() == 1
    assert sinks.parse_uri("s3://b/x/y", "s3") == ("b", "x/y") and sinks.target_path("gcs", {"path": "gs://b/p"}) == "gs://b/p"
    with pytest.raises(ValueError):
        sinks.parse_uri("http://b/x", "s3")
    assert sinks.segment_name("t_0.parquet", 2) == "t_0_part002.parquet" and sinks.split_name("x") == ("x", "dat")
    assert sinks.upload_settings("s3", {"part_mb": 1})["fs.s3a.multipart.size"] == "5M"
    with pytest.raises(RuntimeError):
        sinks.check_space("/", 100, free_bytes=110)


def test_engine_loop_and_replay(spark, data, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    intent = Intent("parquet", {"path": data}, "orders", "o_orderkey", target_config={"path": str(tmp_path / "out")})
    p = engine.profile(intent) | {"n_rows": 1500, "strategy": "range_chunking", "workers": 2}
    planned = engine.plan(intent, profiled=p, rates=CostRates(1.0, 0.1, 0.2))
    assert len(planned.plan.chunks) >= 4 and planned.verdict == "safe" and planned.cost["total"] > 0
    first = engine.execute(intent, planned)
    table = spark.read.parquet(f"{data}/orders.parquet")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert first.status == "success" and first.rows == table.count()
    assert out.exceptAll(table).count() == 0 and table.exceptAll(out).count() == 0
    assert sinks.read_manifest(spark, str(tmp_path / "out"))["total_rows"] == first.rows
    again = engine.replay(intent, first.run_id[:-2])
    told = engine.explain(again.run_id)
    assert told["run"]["replay_of"] == first.run_id and told["run"]["fingerprint"] == engine.explain(first.run_id)["run"]["fingerprint"]
    assert len(engine.history("parquet", "orders")) == 2 and engine.diagnose(first.run_id)["skew"] in ("LOW", "MODERATE", "HIGH")
    assert engine.inspect("parquet", "orders")["verdict"] == "NEEDS ATTENTION"
    told = engine.estimate(intent, p)
    assert told["method"] == "blended" and told["n_matched"] == 2 and "rows/s" in text.estimate(told)
    assert engine.plan(intent, profiled=p).plan.est_throughput > 0
    ctx = RuntimeContext.build({"max_connections": 2, "concurrent": 2})
    stop = engine.plan(intent, ctx, profiled=p)
    assert stop.verdict == "not_recommended" and stop.constrained
    with pytest.raises(NotRecommended):
        engine.execute(intent, stop)
    curve = engine.measure(intent, p, 2)
    assert curve["optimal"] in (1, 2) and engine.store.one("benchmarks", source="parquet", object="orders")["shape"] == curve["shape"]


def test_derby_chunks(spark, tmp_path):
    url = f"jdbc:derby:memory:m{tmp_path.name.replace('-', '')};create=true"
    rows = spark.range(500).selectExpr("cast(id as int) as k", "concat('v', id) as v")
    rows.write.jdbc(url, "T", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    c = connect(spark, "derby", {"url": url, "database": ""}, "T", "k")
    assert c.metadata()["n_rows"] == 500 and c.metadata()["pk_max"] == 499
    got = c.read([(0, 200), (200, 400), (400, 500)])
    assert got.rdd.getNumPartitions() == 3 and got.select("k").distinct().count() == 500
    with pytest.raises(ValidationError):
        connect(spark, "derby", {"url": url, "database": ""}, "T").metadata()
    with pytest.raises(ValidationError):
        connect(spark, "ftp", {}, "T")


def test_command_line(spark, data, tmp_path, capsys):
    common = ["orders", "--config", json.dumps({"path": data}), "--key", "o_orderkey", "--output", str(tmp_path / "o")]
    store = ["--store", str(tmp_path / "s")]
    assert cli.main([*store, "execute", *common], spark) == 0
    rid = json.loads(capsys.readouterr().out.splitlines()[-1])["run_id"]
    assert cli.main([*store, "diagnose", rid], spark) == 0 and cli.main([*store, "explain", "none"], spark) == 1
    ctx = tmp_path / "ctx.json"
    ctx.write_text(json.dumps({"max_connections": 1, "concurrent": 1}))
    assert cli.main([*store, "execute", *common, "--context", str(ctx)], spark) == 2
    assert cli.main([*store, "inspect", "orders"], spark) == 1
