"""The registered queries of the extraction engine and their reference SQL.

Inputs that a live database or a run history would give are read from the data
folder's tables: runs are events, chunk logs are line items, the extracted
table is orders. Decision tables are short literal tables, the same on both
sides. Doubles that pass through a sum are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import kernels as K
from millrace.operators import backoff, chunking, controller, decisions, execution, history, profile, similarity
from millrace.sources import scans
from millrace.sources.tables import chunk_log, load, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_RUNS = """runs as (select event_id as run_id, 'events' as source, user_id as object, ts as start_time, value as throughput,
  case when event_type = 'error' then 'failed' else 'success' end as status, event_type from events)"""
_CHUNKS = """chunks as (select l_suppkey as run_id, l_linenumber as worker_id, l_orderkey as chunk_id, l_linenumber as line, l_quantity as rows,
  l_extendedprice as duration, case when l_returnflag = 'R' then 'failed' else 'success' end as status from lineitem)"""
_LAST = "select *, row_number() over (partition by object order by start_time desc, run_id desc) as seq from runs"


def query(sql: str | None = None):
    """Register a query under its function's name, with its reference SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# Scans and chunks.


@query("select * from orders")
def scan_full(spark, d):
    return scans.full(load(spark, d, "orders"))


@query("select * from orders where o_orderkey >= 500 and o_orderkey < 1500")
def scan_range_chunk(spark, d):
    return scans.key_range(load(spark, d, "orders"), "o_orderkey", 500, 1500)


@query("select * from orders where o_orderkey >= 1200")
def scan_last_chunk(spark, d):
    return scans.key_range(load(spark, d, "orders"), "o_orderkey", 1200)


@query("select * from orders where o_orderkey < 400 or o_orderkey is null")
def scan_first_chunk(spark, d):
    return scans.first_chunk(load(spark, d, "orders"), "o_orderkey", 400)


@query("select count(*) as n_rows from orders where o_orderkey between 100 and 900")
def scan_probe_range(spark, d):
    return scans.probe(load(spark, d, "orders"), "o_orderkey", 100, 900)


@query("select * from events where ts > timestamp '2024-01-20 00:00:00'")
def incremental_scan(spark, d):
    return scans.incremental(load(spark, d, "events"), "ts", "2024-01-20 00:00:00")


@query("select max(ts) as mark from events")
def high_water_mark(spark, d):
    return scans.high_water(load(spark, d, "events"), "ts")


@query("select * from orders order by o_orderkey limit 200 offset 300")
def offset_chunk(spark, d):
    return scans.offset_chunk(load(spark, d, "orders"), "o_orderkey", 300, 200)


@query("select date_trunc('day', ts) as time_start, date_trunc('day', ts) + interval 1 day as time_end, count(*) as n_rows from events group by 1, 2")
def time_window_chunk(spark, d):
    return scans.time_windows(load(spark, d, "events"), "ts", "1 day")


@query("select count(*) as n_rows, min(o_orderkey) as pk_min, max(o_orderkey) as pk_max from orders")
def object_metadata(spark, d):
    return profile.key_stats(load(spark, d, "orders"), "o_orderkey")


_BUCKETS = """b as (select min({k})::double mn, max({k})::double mx from {t}),
  n as (select least(floor(({k} - mn) / ((mx - mn) / 10)), 9)::int as bucket, count(*) as n from {t}, b group by 1),
  h as (select i::int as bucket, mn + i * ((mx - mn) / 10) as lo, coalesce(n, 0) as n_rows from b, range(10) r(i) left join n on n.bucket = i)"""


@query("with " + _BUCKETS.format(k="o_orderkey", t="orders") + " select bucket, round(lo, 6) as lo, n_rows from h")
def pk_histogram(spark, d):
    return profile.histogram(load(spark, d, "orders"), "o_orderkey").select("bucket", _r("lo"), "n_rows")


@query("with " + _BUCKETS.format(k="n_chars", t="documents") + " select round(stddev_pop(n_rows::double) / avg(n_rows::double), 6) as pk_cv from h")
def pk_cv(spark, d):
    return profile.key_cv(load(spark, d, "documents"), "n_chars").select(_r("pk_cv"))


@query(
    """with b as (select o_orderpriority g, min(o_orderkey)::double mn, max(o_orderkey)::double mx from orders group by 1),
  n as (select o_orderpriority g, least(floor((o_orderkey - mn) / ((mx - mn) / 10)), 9)::int as bucket, count(*)::double as n from orders join b on o_orderpriority = g group by 1, 2),
  h as (select b.g, coalesce(n, 0) as n from b cross join range(10) r(i) left join n on n.g = b.g and n.bucket = i)
  select g as o_orderpriority, round(stddev_pop(n) / avg(n), 6) as pk_cv, case when stddev_pop(n) / avg(n) > 1 then 'work_stealing' else 'round_robin' end as scheduling from h group by 1"""
)
def pk_skew_by_group(spark, d):
    return profile.cv_by_group(load(spark, d, "orders"), "o_orderpriority", "o_orderkey").withColumn("pk_cv", F.round("pk_cv", 6))


_PROFILES = """select * from (values (1, 1200000, 174000000, true, 0.2, 100, 2), (2, 90000, 900000000, true, 1.4, 100, 99), (3, 5000000, 40000000, true, 1.0, 20, 5),
  (4, 9000000, 990000000, false, 2.0, 50, 10), (5, 100000, 50000000, true, 1.01, 10, 12), (6, 0, 0, true, 0.0, 10, 1)) as t(id, rows, size, has_key, pk_cv, max_conn, active_conn)"""


@query(
    f"""select id, case when size > 0 and rows > 0 then size // greatest(rows, 1) else 0 end::bigint as avg_row_bytes,
  greatest(1, greatest(0, max_conn - active_conn) // 2)::int as safe_conn,
  case when rows < 100000 or size < 50000000 then 'single_pass' when has_key then 'range_chunking' else 'single_pass' end as strategy,
  case when pk_cv > 1 then 'work_stealing' else 'round_robin' end as scheduling,
  case when rows < 100000 or not has_key then 1 else least(greatest(1, greatest(0, max_conn - active_conn) // 2), greatest(1, least(8, rows // 500000))) end::int as workers
  from ({_PROFILES})"""
)
def profile_recommend(spark, d):
    out = profile.recommend(_values(spark, _PROFILES))
    return out.select("id", "avg_row_bytes", "safe_conn", "strategy", "scheduling", "workers")


_RANGES = """s as (select count(*) n_rows, min(o_orderkey) mn, max(o_orderkey) mx from orders),
  n as (select *, greatest(6, n_rows // 2000, 1)::int as n from s),
  c as (select i::int as chunk, round_even(mn + i * ((mx - mn)::double / n), 0)::bigint as lo,
    case when i = n - 1 then mx + 1 else round_even(mn + (i + 1) * ((mx - mn)::double / n), 0)::bigint end as hi, (n_rows // n)::bigint as est_rows from n, range(200) r(i) where i < least(n, 200))"""


def _orders_chunks(spark, d):
    orders = load(spark, d, "orders")
    chunks = chunking.range_chunks(profile.key_stats(orders, "o_orderkey"), workers=3, row_bytes=145, rows_each=2000)
    return orders, chunks


@query("with " + _RANGES + " select chunk, lo, hi, est_rows, est_rows * 145 as est_bytes, (select count(*) from orders where o_orderkey >= lo and o_orderkey < hi) as n_rows from c")
def range_chunks(spark, d):
    orders, chunks = _orders_chunks(spark, d)
    return chunking.counted(orders, "o_orderkey", chunks)


@query("with " + _RANGES + " select count(*) as table_rows, count(chunk)::bigint as chunk_rows, 0::bigint as overlaps from orders left join c on o_orderkey >= lo and o_orderkey < hi")
def chunk_reassembly(spark, d):
    orders, chunks = _orders_chunks(spark, d)
    return chunking.reassembly(orders, "o_orderkey", chunks).select("table_rows", F.col("chunk_rows").cast("long").alias("chunk_rows"), F.col("overlaps").cast("long").alias("overlaps"))


@query("with " + _RANGES + ", m as (select chunk, (select count(*) from orders where o_orderkey >= lo and o_orderkey < hi) as n_rows from c) select chunk, n_rows, row_number() over (order by n_rows desc, chunk)::int as dispatch from m")
def chunk_schedule_lpt(spark, d):
    orders, chunks = _orders_chunks(spark, d)
    return chunking.schedule(chunking.counted(orders, "o_orderkey", chunks)).select("chunk", "n_rows", "dispatch")


# Run history.


@query(f"with {_RUNS} select * exclude (event_type) from runs where object = 7 order by start_time desc, run_id desc limit 10")
def recent_runs(spark, d):
    return history.recent_runs(runs(spark, d).drop("event_type"), 7)


@query(f"with {_RUNS} select object, run_id, source, start_time, throughput, status from ({_LAST}) where seq = 1")
def last_run_any_source(spark, d):
    return history.last_run(runs(spark, d))


@query(f"with {_RUNS} select object, run_id, start_time, throughput, row_number() over (partition by object order by start_time desc, run_id desc)::int as seq from runs where status = 'success' and throughput > 0 qualify seq <= 20")
def recent_throughputs(spark, d):
    return history.last_n(history.successful(runs(spark, d)), 20).select("object", "run_id", "start_time", "throughput", "seq")


@query(f"with {_RUNS} select run_id, object, throughput from runs where starts_with(run_id::varchar, '12') order by (run_id::varchar = '12') desc, start_time desc, run_id desc limit 1")
def run_prefix_lookup(spark, d):
    return history.by_prefix(runs(spark, d), "12").select("run_id", "object", "throughput")


@query(f"with {_RUNS} select run_id, object, lag(run_id) over w as prev_run_id, lag(throughput) over w as prev_throughput from runs window w as (partition by source, object order by start_time, run_id)")
def run_previous(spark, d):
    return history.previous(runs(spark, d)).select("run_id", "object", "prev_run_id", "prev_throughput")


_DELTA = "case when {p} is null then null when {p} > 0 then ({c} - {p}) / {p} else 0.0 end"


@query(f"with {_RUNS}, p as (select *, lag(throughput) over (partition by object order by start_time, run_id) as p from runs) select run_id, round({_DELTA.format(c='throughput', p='p')}, 6) as delta from p")
def throughput_deltas(spark, d):
    return history.deltas(runs(spark, d)).select("run_id", _r("delta"))


@query(f"with {_RUNS} select object, run_id, throughput, seq::int as seq from ({_LAST}) where seq <= 5")
def controller_window(spark, d):
    return history.last_n(runs(spark, d), 5).select("object", "run_id", "throughput", "seq")


@query(
    f"""with {_RUNS}, l as ({_LAST}), g as (select object, count(*) as n_runs, avg(throughput) filter (seq > 3) as older, avg(throughput) filter (seq <= 3) as newer from l where seq <= 5 group by 1)
  select object, n_runs, round(older, 6) as older, round(newer, 6) as newer, round((newer - older) / older, 6) as drift from g where n_runs = 5"""
)
def drift_half_window(spark, d):
    return history.drift(runs(spark, d)).select("object", "n_runs", _r("older"), _r("newer"), _r("drift"))


@query(
    f"""with {_RUNS}, l as ({_LAST}), e as (select object, lag(throughput) over (partition by object order by seq desc) as p, throughput as c from l where seq <= 5),
  x as (select object, (c - p) / p as x from e where p > 0)
  select object, count(*) as n_deltas, count(*) filter (x < -0.01) as down, count(*) filter (x > 0.01) as up, count(*) filter (x < -0.01)::double / count(*) >= 0.8 as consistent_down from x group by 1"""
)
def directional_counts(spark, d):
    return history.directions(runs(spark, d))


@query(
    f"""with {_RUNS}, l as ({_LAST}), t as (select object, max(throughput) filter (seq = 1) as t1, max(throughput) filter (seq = 2) as t2, max(throughput) filter (seq = 3) as t3,
  arg_max(throughput, seq) as f, max(seq) as n from l where seq <= 5 group by 1)
  select object, round((t2 - t3) / t3, 6) as drop_1, round((t1 - t2) / t2, 6) as drop_2, round((t1 - f) / f, 6) as drop_total,
  (t2 - t3) / t3 <= -0.15 and (t1 - t2) / t2 <= -0.15 and (t1 - f) / f <= -0.2 as escape from t where n >= 3"""
)
def escape_check(spark, d):
    return history.escapes(runs(spark, d)).select("object", *(K.rounded(F.col(c), 6).alias(c) for c in ("drop_1", "drop_2", "drop_total")), "escape")


@query(f"with {_RUNS}, s as (select object, list(throughput order by start_time, run_id) as s from runs group by 1) select object, len(s) as n_runs, round(list_reduce(s, lambda a, x: 0.3 * x + 0.7 * a), 6) as ewma from s")
def ewma_by_object(spark, d):
    return history.smoothed(runs(spark, d)).select("object", "n_runs", _r("ewma"))


_ANOMALY = f"""{_RUNS}, b as (select *, count(*) over w as n_base, avg(throughput) over w as mean, stddev_pop(throughput) over w as sigma from runs
    window w as (partition by object order by start_time, run_id rows between 20 preceding and 1 preceding)),
  z as (select *, case when n_base < 5 then false when sigma < 1e-6 then mean > 0 and abs(throughput - mean) / mean > 0.2 else abs(throughput - mean) / sigma > 2 end as is_anomaly,
    case when n_base < 5 then 0.0 when sigma < 1e-6 then case when mean > 0 and abs(throughput - mean) / mean > 0.2 then abs(throughput - mean) / mean / 0.2 else 0.0 end else abs(throughput - mean) / sigma end as z from b)"""


@query(f"with {_ANOMALY} select run_id, n_base, round(mean, 6) as mean, round(sigma, 6) as sigma, round(z, 6) as z, is_anomaly, case when not is_anomaly then 'none' when throughput < mean then 'degradation' else 'improvement' end as direction from z")
def zscore_anomaly(spark, d):
    return history.anomalies(runs(spark, d)).select("run_id", "n_base", _r("mean"), _r("sigma"), _r("z"), "is_anomaly", "direction")


@query(f"with {_ANOMALY}, l as (select *, row_number() over (partition by object order by start_time desc, run_id desc) as seq from z) select object, count(*) as n_runs, count(*) filter (is_anomaly) as n_anomalies from l where seq <= 3 group by 1")
def anomaly_recurrence(spark, d):
    return history.recurrence(history.anomalies(runs(spark, d)))


_TREND = f"""{_RUNS}, l as ({_LAST}), t as (select object, count(*) as n_runs, arg_max(throughput, seq) * 100 as first, arg_min(throughput, seq) * 100 as last from l where seq <= 5 and throughput > 0 group by 1),
  u as (select *, (last - first) / first * 100 as drift_pct from t)"""


@query(
    f"""with {_TREND} select object, n_runs, round(first, 6) as first, round(last, 6) as last, round(drift_pct, 6) as drift_pct,
  case when n_runs < 3 then 'insufficient history' when first < 1000 then 'insufficient signal' when abs(drift_pct) < 5 then 'stable' when drift_pct > 0 then 'improving' else 'degrading' end as trend from u"""
)
def trend_last5(spark, d):
    return history.trend(runs(spark, d), scale=100.0).select("object", "n_runs", _r("first"), _r("last"), _r("drift_pct"), "trend")


_WORKERS = "(run_id % 4 + 1)::int as workers"


@query(
    f"""with {_RUNS}, w as (select *, {_WORKERS} from runs), p as (select *, lag(workers) over v as pw, lag(throughput) over v as pt from w window v as (partition by object order by start_time, run_id)),
  c as (select *, case when pt is null then 0.0 when pt > 0 then (throughput - pt) / pt else 0.0 end as change from p)
  select run_id, workers, round(change, 6) as change, case when workers > pw and change > 0.05 or workers < pw and change < -0.05 then 'under_parallel'
    when workers > pw and change < -0.05 or workers < pw and change > 0.05 then 'over_parallel' else 'stable' end as category from c"""
)
def deviation_diagnosis(spark, d):
    rows = runs(spark, d).withColumn("workers", (F.pmod("run_id", F.lit(4)) + 1).cast("int"))
    return history.diagnosis(rows).select("run_id", "workers", _r("change"), "category")


@query(
    f"""with {_RUNS}, w as (select *, {_WORKERS} from runs), p as (select *, lag(workers) over v as pw, lag(throughput) over v as pt from w window v as (partition by object order by start_time, run_id)),
  c as (select *, case when pt > 0 then (throughput - pt) / pt else 0.0 end as change from p),
  dev as (select run_id, case when workers > pw and change > 0.05 or workers < pw and change < -0.05 then 'under_parallel' when workers > pw and change < -0.05 or workers < pw and change > 0.05 then 'over_parallel' else 'stable' end as category from c)
  select r.run_id, r.object, r.throughput, coalesce(dev.category, '-') as cause from runs r left join dev on r.run_id = dev.run_id and dev.category <> 'stable'"""
)
def history_with_deviation(spark, d):
    rows = runs(spark, d).withColumn("workers", (F.pmod("run_id", F.lit(4)) + 1).cast("int"))
    dev = history.diagnosis(rows).where("category <> 'stable'").select("run_id", F.col("category").alias("cause"))
    return runs(spark, d).join(dev, "run_id", "left").select("run_id", "object", "throughput", F.coalesce("cause", F.lit("-")).alias("cause"))


@query(
    f"""with {_RUNS}, n as (select *, row_number() over (partition by object order by start_time, run_id) as n from runs),
  f as (select object, n - row_number() over (partition by object order by n) as i from n where event_type = 'click') , g as (select object, i, count(*) as len from f group by 1, 2) select object, max(len) as longest from g group by 1"""
)
def longest_streak(spark, d):
    return history.longest_streak(runs(spark, d), "object", ["start_time", "run_id"], F.col("event_type") == "click")


@query(
    f"""with {_ANOMALY}, l as (select *, row_number() over (partition by object order by start_time desc, run_id desc) as seq from z),
  a as (select object, count(*) filter (is_anomaly) as n_anomalies, max(status) filter (seq = 1) as status from l where seq <= 3 group by 1),
  t as (select object, count(*) as n_runs, arg_max(throughput, seq) * 100 as first, arg_min(throughput, seq) * 100 as last from l where seq <= 5 and throughput > 0 group by 1)
  select object, status, n_anomalies, case when status <> 'success' or n_anomalies >= 2 or (n_runs >= 3 and first >= 1000 and (last - first) / first * 100 < -20) then 'DEGRADED'
    when n_anomalies > 0 or object % 5 = 0 or object % 7 = 0 then 'NEEDS ATTENTION' else 'HEALTHY' end as verdict from a join t using (object)"""
)
def health_verdict(spark, d):
    r = runs(spark, d)
    found = history.recurrence(history.anomalies(r)).select("object", "n_anomalies")
    last = history.last_run(r).select("object", "status")
    rows = last.join(found, "object").join(history.trend(r, scale=100.0).select("object", "n_runs", "first", "drift_pct"), "object")
    rows = rows.withColumn("profile_stale", F.pmod("object", F.lit(5)) == 0).withColumn("controller_ok", F.pmod("object", F.lit(7)) != 0)
    return history.health(rows).select("object", "status", "n_anomalies", "verdict")


@query()
def controller_replay(spark, d):
    return controller.replay(runs(spark, d))


# Chunk logs.


@query(
    f"""with {_CHUNKS}, t as (select run_id, count(*) as n_chunks, count(*) filter (status <> 'success') as n_failed, sum(case when status = 'success' then rows else 0 end) as total_rows,
  sum(case when status = 'success' then duration else 0 end) as total_time from chunks group by 1)
  select run_id, n_chunks, n_failed, total_rows, round(total_time, 2) as total_time, round(case when total_time > 0 then total_rows / total_time else 0 end, 8) as throughput, case when n_failed > 0 then 'FAILED' else 'SUCCESS' end as status from t"""
)
def run_totals(spark, d):
    return execution.totals(chunk_log(spark, d)).select("run_id", "n_chunks", "n_failed", "total_rows", _r("total_time", 2), _r("throughput", 8), "status")


@query(
    f"""with {_CHUNKS}, w as (select run_id, worker_id, sum(duration) as busy from chunks where status = 'success' group by 1, 2)
  select run_id, round(greatest(1.0, least(4.0, case when max(busy) > 0 then sum(busy) / max(busy) else 4.0 end)), 6) as effective from w group by 1"""
)
def effective_workers(spark, d):
    return execution.effective_workers(chunk_log(spark, d), 4).select("run_id", _r("effective"))


@query(
    f"""with {_CHUNKS}, w as (select run_id, worker_id, count(*) as n_chunks, sum(rows) as rows, sum(duration) as busy from chunks where status = 'success' group by 1, 2)
  select run_id, worker_id, n_chunks, rows, round(busy, 2) as busy, round(case when max(busy) over (partition by run_id) > 0 then 1 - busy / max(busy) over (partition by run_id) else 0 end, 6) as idle_pct from w"""
)
def worker_distribution(spark, d):
    return execution.workers(chunk_log(spark, d)).select("run_id", "worker_id", "n_chunks", "rows", _r("busy", 2), _r("idle_pct"))


_SKEW = f"""{_CHUNKS}, k as (select run_id, max(duration) as longest, list_sort(list(duration))[count(*) // 2 + 1] as median, count(*) as n, stddev_pop(duration) as s, avg(duration) as m from chunks group by 1),
  r as (select *, longest / median as ratio from k)"""


@query(f"with {_SKEW} select run_id, longest, median, round(ratio, 6) as ratio, round(case when n >= 2 and m > 0 then s / m else 0 end, 6) as cv, case when ratio > 3 then 'HIGH' when ratio > 1.5 then 'MODERATE' else 'LOW' end as skew from r")
def chunk_skew(spark, d):
    return execution.skew(chunk_log(spark, d)).select("run_id", "longest", "median", _r("ratio"), _r("cv"), "skew")


@query(
    f"with {_SKEW}, x as (select run_id, row_number() over (partition by run_id order by duration desc, chunk_id, line)::int as rank, chunk_id, line, duration from chunks) select x.* from x where rank <= 3 and run_id in (select run_id from r where ratio > 1.5)"
)
def slowest_top3(spark, d):
    return execution.slowest(chunk_log(spark, d))


@query(
    f"""with {_CHUNKS}, o as (select *, row_number() over (partition by run_id order by duration, chunk_id, line) as f, row_number() over (partition by run_id order by duration desc, chunk_id, line) as s from chunks)
  select run_id, max(chunk_id) filter (f = 1) as fastest, min(duration) as fastest_s, max(chunk_id) filter (s = 1) as slowest, max(duration) as slowest_s from o group by 1"""
)
def chunk_fastest_slowest(spark, d):
    return execution.extremes(chunk_log(spark, d))


@query(f"with {_CHUNKS} select run_id, round(max(rows / duration), 8) as peak, round(min(rows / duration), 8) as low from chunks where duration > 0 group by 1")
def chunk_peak_min_tp(spark, d):
    return execution.throughput_range(chunk_log(spark, d)).select("run_id", _r("peak", 8), _r("low", 8))


_FIRED = "select * from (values (1, 0, 40), (2, 2, 40), (3, 8, 40), (4, 9, 40), (5, 3, 0)) as t(id, activations, chunks)"


@query(
    f"""with f as (select *, case when chunks > 0 then activations::double / chunks else 0 end as rate from ({_FIRED})) select id, round(rate, 6) as rate,
  case when rate <= 0.05 then 'note' when rate <= 0.2 then 'moderate' else 'low' end as impact, case when rate <= 0.05 then 'full' when rate <= 0.2 then 'moderate' else 'low' end as confidence from f"""
)
def rule_confidence(spark, d):
    return execution.rule_confidence(_values(spark, _FIRED)).select("id", _r("rate"), "impact", "confidence")


@query(
    f"""with recursive {_CHUNKS}, c as (select run_id::bigint as run_id, row_number() over (partition by run_id order by lpad(chunk_id::varchar, 12, '0') || '.' || line::varchar) as i, duration / 1000 as ms from chunks),
  f as (select *, ms > 55 as high from c),
  w as (select run_id, 0::bigint as i, 0 as passed, 0::bigint as activations, 0::double as paused_s, 0::bigint as breaches from c where i = 1
    union all select w.run_id, f.i, case when high and activations < 10 and passed >= 3 then 0 else passed + 1 end, activations + (high and activations < 10 and passed >= 3)::int,
    paused_s + case when high and activations < 10 and passed >= 3 then least(pow(2, activations), 30) else 0 end, breaches + high::int from w join f on f.run_id = w.run_id and f.i = w.i + 1)
  select run_id, i as chunks, activations, paused_s, breaches, case when breaches / i <= 0.05 then 'note' when breaches / i <= 0.2 then 'moderate' else 'low' end as impact from w qualify i = max(i) over (partition by run_id)"""
)
def adaptive_backoff(spark, d):
    rows = chunk_log(spark, d).select(F.col("run_id").cast("long").alias("run_id"), F.struct("chunk_id", "line").alias("seq"), (F.col("duration") / 1000).alias("query_ms"))
    return backoff.replay(rows.select("run_id", F.concat_ws(".", F.lpad("seq.chunk_id", 12, "0"), "seq.line").alias("seq"), "query_ms"), backoff.Rule(threshold_ms=55.0))


# Decisions.


_BASE = """select * from (values (1, 0.8, 0.5, 8, 900.0, 6, 4, 49, 8, null), (2, 0.8, 0.3, 8, 900.0, 6, 4, 49, 8, 5), (3, 0.4, 0.9, 8, 900.0, 6, 4, 49, 8, 5), (4, null, null, null, 0.0, 6, 4, 49, 8, null), (5, null, null, null, null, null, 0, 3, 8, 2),
  (6, 0.9, 0.9, 8, 10.0, 2, 1, 3, 16, 64)) as t(id, bench_conf, bench_signal, bench_workers, ctl_throughput, ctl_workers, prof_workers, safe, cores, cap)"""


@query(
    f"""with b as (select *, case when bench_conf >= 0.5 then case when bench_signal <= 0.3 then least(bench_workers, 2) else bench_workers end end as w from ({_BASE}))
  select id, case when w is not null then 'benchmark' when ctl_throughput > 0 then 'controller' else 'profiler' end as origin,
  greatest(1, least(coalesce(w, case when ctl_throughput > 0 then ctl_workers end, prof_workers), safe, cores, coalesce(cap, 64)))::int as workers from b"""
)
def resolve_base_workers(spark, d):
    return decisions.base_workers(_values(spark, _BASE)).select("id", "origin", "workers")


_CONTEXTS = """select * from (values (1, 8, 0.0, null, null, null, null, null, null, null), (2, 8, 0.0, 4, null, null, null, null, null, null), (3, 8, 0.0, 4, 4, null, null, null, null, null),
  (4, 8, 100.0, null, null, 350, 'degraded', 'high', true, 'critical'), (5, 8, 0.0, 6, 1, 350, 'poor', 'high', true, 'low'), (6, 8, 0.0, null, 3, null, 'good', 'low', false, 'critical'),
  (7, 5, 200.0, null, null, 100, null, 'high', null, 'low'), (8, 0, 0.0, null, null, null, 'poor', null, null, 'critical')) as t(id, base, per_worker_mb, max_connections, concurrent, max_memory_mb, network, load, maintenance, priority)"""

_WATERFALL = f"""c as (select *, max_connections - coalesce(concurrent, 0) as l, greatest(1, base) as b from ({_CONTEXTS})),
  d as (select *, coalesce(max_connections is not null and concurrent is not null and l <= 0, false) as none, greatest(1, least(b, coalesce(case when max_connections is not null then l end, b), coalesce(case when per_worker_mb > 0 then floor(max_memory_mb / per_worker_mb)::int end, b))) as after_caps,
    greatest(0.25, case network when 'degraded' then 0.75 when 'poor' then 0.5 else 1.0 end * case load when 'high' then 0.5 else 1.0 end * case when coalesce(maintenance, false) then 0.5 else 1.0 end)::double as factor from c),
  e as (select *, greatest(1, floor(after_caps * factor)::int) as after_factors from d),
  f as (select *, greatest(1, case priority when 'low' then greatest(1, floor(after_factors * 0.75)::int) when 'critical' then least(after_caps, floor(after_factors * 1.25)::int) else after_factors end) as workers from e),
  waterfall as (select id, case when none then 0 else after_caps end::int as after_caps, case when none then 1.0 else factor end::double as factor, case when none then 0 else after_factors end::int as after_factors, case when none then 0 else workers end::int as workers from f)"""


@query(f"with {_WATERFALL} select * from waterfall")
def resolve_workers(spark, d):
    return decisions.waterfall(_values(spark, _CONTEXTS)).select("id", "after_caps", "factor", "after_factors", "workers")


_LIMITS = """select * from (values (1, 12.0, 1073741824, 10, null, 5.0, null), (2, 12.0, 10737418240, 15, 10, 20.0, 5000.0), (3, 12.0, 10737418240, 15, 15, 11.0, 20000.0), (4, 12.0, 10737418240, null, 12, 9.5, null),
  (5, 1.0, 1048576, 1, 1, 1.0, 1.0), (6, 3.0, 2097152, null, null, null, 1.0), (7, 3.0, 1, 10, 10, 1.0, null), (8, 3.0, 1, 2, null, null, null)) as t(id, est_minutes, out_bytes, target_minutes, window_minutes, disk_gb, egress_mb)"""

_ADVICE = f"""limits as ({_LIMITS}), advice as (
  select id, 'target_duration' as field, case when est_minutes > target_minutes then 'warn' else 'pass' end as severity from limits where target_minutes is not null
  union all select id, 'maintenance_window', case when est_minutes > window_minutes then 'fail' else 'pass' end from limits where window_minutes is not null
  union all select id, 'disk', case when out_bytes / 1073741824.0 > disk_gb then 'fail' when out_bytes / 1073741824.0 > disk_gb * 0.8 then 'warn' else 'pass' end from limits where disk_gb is not null
  union all select id, 'egress_budget', case when out_bytes / 1048576.0 > egress_mb then 'warn' else 'pass' end from limits where egress_mb is not null)"""


@query(f"with {_ADVICE} select *, case severity when 'fail' then 1 when 'warn' then 2 else 3 end::int as rank from advice")
def advisories(spark, d):
    return decisions.advisories(_values(spark, _LIMITS)).select("id", "field", "severity", "rank")


@query(
    f"""with {_WATERFALL}, {_ADVICE}, v as (select id, any_value(workers) as workers, coalesce(bool_or(severity = 'fail' and field in ('maintenance_window', 'disk')), false) as stop, coalesce(bool_or(severity in ('fail', 'warn')), false) as look
  from waterfall left join advice using (id) group by 1) select id, case when workers = 0 or stop then 'not_recommended' when look then 'safe_with_warnings' else 'safe' end as verdict from v"""
)
def verdict(spark, d):
    rows = decisions.waterfall(_values(spark, _CONTEXTS)).select("id", "workers")
    found = decisions.advisories(_values(spark, _LIMITS)).select("id", "field", "severity")
    return decisions.verdicts(rows.join(found, "id", "left"), "id")


_LATENCY = "select * from (values (1, 0.5, 145, 8), (2, 2.0, 145, 4), (3, 30.0, 145, 2), (4, 0.2, 0, 3), (5, 1.0, 4000, 1)) as t(id, p50, row_bytes, workers)"


@query(
    f"""select id, round(case when p50 > 1 then least(500000.0, 1000 / p50 * 100 * sqrt(workers)) when row_bytes > 0 then least(500000.0, 25.0 * 1048576 * sqrt(workers) / greatest(row_bytes, 1)) else 10000.0 end, 6) as throughput from ({_LATENCY})"""
)
def throughput_fallback(spark, d):
    return _values(spark, _LATENCY).select("id", F.round(decisions.fallback_throughput(F.col("p50"), F.col("row_bytes"), F.col("workers")), 6).alias("throughput"))


@query(f"select id, case when p50 >= 1 then 5 * p50 end::double as threshold_ms, case when p50 >= 1 then greatest(50.0, 10 * p50) end::double as floor_ms, case when p50 >= 1 then 10 end::int as most from ({_LATENCY})")
def adaptive_rules(spark, d):
    rule = decisions.adaptive_rule(F.col("p50"))
    return _values(spark, _LATENCY).select("id", rule["threshold_ms"].cast("double").alias("threshold_ms"), rule["floor_ms"].cast("double").alias("floor_ms"), rule["most"].alias("most"))


_COSTS = """select * from (values (1, 8, 50000.0, 100000000, 50000000000, 0.5, 0.09, 0.02, 16), (2, 1, 20000.0, 9000000, 1000000000, 0.5, 0.0, 0.9, 16), (3, 16, 1000.0, 5000000, 900000000, 0.0, 0.09, 0.0, 16),
  (4, 5, 9000.0, 80000000, 20000000000, 0.01, 0.01, 2.5, 6), (5, 3, 9000.0, 80000000, 20000000000, 4.0, 0.01, 0.0, 16)) as t(key, workers, per_worker, n_rows, out_bytes, compute_rate, egress_rate, connection_rate, hard_cap)"""
_COST = "{s} / 3600.0 * compute_rate as compute, out_bytes / 1073741824.0 * egress_rate as egress, workers * {s} / 3600.0 * connection_rate as connections"


@query(f"with c as (select key, {_COST.format(s='(n_rows / (per_worker * workers))')} from ({_COSTS})) select key, round(compute, 6) as compute, round(egress, 6) as egress, round(connections, 6) as connections, round(compute + egress + connections, 6) as total from c")
def cost_estimate(spark, d):
    rows = _values(spark, _COSTS).withColumn("seconds", F.col("n_rows") / (F.col("per_worker") * F.col("workers")))
    return decisions.costs(rows).select("key", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("compute", "egress", "connections", "total")))


@query(
    f"""with c as (select *, workers as planned, greatest(1, round_even(workers * 0.5, 0)::int) as step from ({_COSTS})),
  o as (select distinct * replace (w as workers) from (select *, unnest([greatest(1, workers - step), workers, least(hard_cap, workers + step)]) as w from c)),
  s as (select key, workers::int as workers, planned, (n_rows / (per_worker * workers))::double as seconds, {_COST.format(s='(n_rows / (per_worker * workers))')} from o), t as (select *, compute + egress + connections as total from s)
  select key, workers, round(seconds, 6) as seconds, round(total, 6) as total, workers = planned as is_planned from t a where workers = planned or not exists (select 1 from t b where b.key = a.key and b.workers <> a.workers and b.seconds <= a.seconds and b.total <= a.total)"""
)
def cost_comparison(spark, d):
    return decisions.options(_values(spark, _COSTS)).select("key", "workers", F.round(F.col("seconds").cast("double"), 6).alias("seconds"), F.round(F.col("total").cast("double"), 6).alias("total"), "is_planned")


_CURVES = """select * from (values ('a', 1, 100.0, 0.05), ('a', 2, 190.0, 0.1), ('a', 4, 200.0, 0.1), ('a', 8, 196.0, 0.1), ('b', 1, 100.0, 0.3), ('b', 2, 150.0, 0.2), ('b', 4, 210.0, 0.25), ('b', 8, 260.0, 0.2),
  ('c', 1, 100.0, 0.0), ('c', 2, 220.0, 0.0), ('c', 4, 120.0, 0.0), ('c', 8, 90.0, 0.0), ('d', 1, 100.0, 1.2), ('d', 2, 60.0, 1.1), ('e', 4, 50.0, 0.0)) as t(key, workers, tp, cv)"""


@query(f"with c as ({_CURVES}) select key, min(workers)::int as optimal from c where tp >= 0.95 * (select max(tp) from c x where x.key = c.key) group by 1")
def optimal_workers(spark, d):
    return decisions.optimal_workers(_values(spark, _CURVES), "key")


_SHAPES = f"""c as ({_CURVES}), m as (select key, max(tp) as top, min(tp) as low, count(*) as n, avg(cv) as cv, arg_max(workers, workers) as last from c group by 1),
  p as (select key, min(workers) as peak from c join m using (key) where tp = top group by 1),
  s as (select m.*, case when n < 2 then 'plateau' when peak = last then 'increasing' when not exists (select 1 from c x where x.key = m.key and x.workers > peak and x.tp < 0.95 * top) then 'plateau'
    when peak > (select min(workers) from c x where x.key = m.key) then 'non_monotonic' else 'plateau' end as shape from m join p using (key))"""


@query(f"with {_SHAPES} select key, shape from s")
def bench_curve_shape(spark, d):
    return decisions.bench_confidence(_values(spark, _CURVES), "key").select("key", "shape")


@query(f"with {_SHAPES} select key, round(greatest(0, 1 - cv)::double * case shape when 'plateau' then 1 when 'increasing' then 0.75 else 0.7 end::double, 6) as confidence, round(case when top > 0 then greatest(0.15, (top - low) / top) else 0.15 end::double, 6) as signal from s")
def bench_confidence(spark, d):
    return decisions.bench_confidence(_values(spark, _CURVES), "key").select("key", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), F.round(F.col("signal").cast("double"), 6).alias("signal"))


_PROBES = "select * from (values (1, 0, 1000000, 50000), (2, 10, 120000, 50000), (3, 0, 150000, 50000), (4, -500, 90000, 20000)) as t(id, pk_min, pk_max, size)"


@query(
    f"""with t as (select *, pk_max - pk_min as span, (pk_max - pk_min) // 3 as third from ({_PROBES})), m as (select *, greatest(pk_min + size + 1, pk_min + third + third // 2 - size // 2) as mid, greatest(pk_min + size + 1, pk_max - size) as short from t),
  h as (select *, greatest(mid + size + 1, pk_max - size) as high from m)
  select id, 'low' as label, pk_min::bigint as start, (pk_min + size - 1)::bigint as end from h union all select id, 'mid', mid::bigint, (mid + size - 1)::bigint from h where span >= 3 * size
  union all select id, 'high', case when span < 3 * size then short else high end::bigint, least(case when span < 3 * size then short else high end + size - 1, pk_max)::bigint from h"""
)
def probe_ranges(spark, d):
    return decisions.probe_ranges(_values(spark, _PROBES)).select("id", "label", "start", "end")


@query("select n, greatest(50000, least(100000, floor(n * 0.02)::int))::int as probe_rows from (values (1000), (3000000), (4999999), (90000000)) t(n)")
def probe_rows(spark, d):
    return _values(spark, "select * from (values (1000), (3000000), (4999999), (90000000)) t(n)").select("n", decisions.probe_rows(F.col("n")).cast("int").alias("probe_rows"))


_STALE = "select * from (values (1, 1.0, 100, 119), (2, 7.5, 100, 100), (3, 7.0, 100, 121), (4, 2.0, 100, 79), (5, 2.0, 0, 50)) as t(id, age, then_rows, now_rows)"


@query(f"select id, age > 7 or (then_rows > 0 and abs(now_rows - then_rows)::double / then_rows > 0.2) as stale from ({_STALE})")
def bench_staleness(spark, d):
    return _values(spark, _STALE).select("id", decisions.bench_stale(F.col("age"), F.col("then_rows"), F.col("now_rows")).alias("stale"))


_LEVELS = "select * from (values (1, 5, 0.9, 0.1, false), (2, 5, 0.9, 0.3, false), (3, 5, 0.9, 0.3, true), (4, 2, 0.55, null, false), (5, 1, 0.99, null, true), (6, 3, 0.6, 0.1, true), (7, 0, null, null, null)) as t(id, n, best, cv, dominant)"


@query(
    f"""with b as (select *, case when n >= 3 and best >= 0.7 then 0 when n >= 2 and best >= 0.5 then 1 else 2 end + coalesce((cv > 0.2)::int, 0) + coalesce(dominant::int, 0) as l from ({_LEVELS})) select id, ['high', 'medium', 'low'][least(2, l) + 1] as level from b"""
)
def confidence_level(spark, d):
    return _values(spark, _LEVELS).select("id", decisions.confidence_level(F.col("n"), F.col("best"), F.col("cv"), F.col("dominant")).alias("level"))


# Contexts.


_CURRENT = "select 'normal' as source_load, 2 as concurrent, 1 as time_band, cast(0.3 as double) as system_load, 'good' as network, 1200000 as row_estimate"
_CANDIDATES = """select cast(event_id as int) as id, case event_id % 5 when 0 then 'low' when 1 then 'normal' when 2 then 'high' when 3 then 'critical' else 'odd' end as source_load, cast(user_id % 25 as int) as concurrent,
  cast(event_id % 6 as int) as time_band, case when event_id % 7 = 0 then null else (event_id % 20) / 10.0 end as system_load, case event_id % 4 when 0 then 'excellent' when 1 then 'good' when 2 then 'degraded' else 'poor' end as network,
  cast(400000 + (event_id % 40) * 60000 as bigint) as row_estimate, event_id % 11 <> 0 as has_context, event_id % 13 = 0 as is_benchmark, value as throughput, cast(event_id % 60 as double) as age_days from events"""
_SIM = """cur as ({cur}), cand as ({cand}), s as (select c.*, (0.3 * case when c.source_load = 'odd' then 0.5 else case abs(list_position(['low', 'normal', 'high', 'critical'], c.source_load) - list_position(['low', 'normal', 'high', 'critical'], u.source_load)) when 0 then 1.0 when 1 then 0.5 else 0.1 end end
  + 0.25 * exp(-((least(c.concurrent, 20) - least(u.concurrent, 20)) ** 2) / 8.0)
  + 0.2 * case least(abs(c.time_band - u.time_band), 6 - abs(c.time_band - u.time_band)) when 0 then 1.0 when 1 then 0.6 when 2 then 0.2 else 0.0 end
  + 0.15 * coalesce(exp(-((c.system_load - u.system_load) ** 2) / 0.5), 1.0)
  + 0.1 * case abs(list_position(['excellent', 'good', 'degraded', 'poor'], c.network) - list_position(['excellent', 'good', 'degraded', 'poor'], u.network)) when 0 then 1.0 when 1 then 0.5 when 2 then 0.2 else 0.0 end)::double as sim,
  abs(c.row_estimate - u.row_estimate)::double / greatest(c.row_estimate, u.row_estimate) > 0.5 as grown from cand c, cur u),
  scored as (select *, case when has_context and not is_benchmark then sim else 0.0 end as score, case when not has_context then 'no_context_recorded' when is_benchmark then 'benchmark_run' when grown then 'row_growth' when sim < 0.2 then 'score_too_low' end as reason from s)""".format(cur=_CURRENT, cand=_CANDIDATES)


def _candidates(spark, d):
    load(spark, d, "events").createOrReplaceTempView("_events")
    return spark.sql(_CANDIDATES.replace("from events", "from _events"))


@query(f"with {_SIM} select id, round(score, 6) as score, reason from scored")
def context_similarity(spark, d):
    return similarity.score_runs(_values(spark, _CURRENT), _candidates(spark, d)).select("id", _r("score"), "reason")


_EST = f"""{_SIM}, m as (select count(*) as n_matched, max(score) as best, sum(score * exp(-0.05 * age_days)) as weight, sum(score * exp(-0.05 * age_days) * throughput) as weighted, max(score * exp(-0.05 * age_days)) as heaviest, stddev_pop(throughput) / avg(throughput) as cv from scored where reason is null),
  h as (select list(throughput order by id) as s, min(throughput) as lo, max(throughput) as hi, count(*) filter (has_context) as depth from scored where id < 500),
  e as (select *, list_reduce(s, lambda a, x: 0.3 * x + 0.7 * a) as ewma, weighted / weight as context, least(1.0, best * least(1.0, depth / 10.0)) as alpha from m, h),
  f as (select *, alpha * context + (1 - alpha) * ewma as blended from e)"""


@query(
    f"""with {_EST} select n_matched, round(context, 4) as context, round(ewma, 4) as ewma, round(alpha, 6) as alpha, round(blended, 4) as blended, round(greatest(0.75 * lo, least(1.25 * hi, blended)), 4) as value, 'blended' as method,
  ['high', 'medium', 'low'][least(2, case when n_matched >= 3 and best >= 0.7 then 0 when n_matched >= 2 and best >= 0.5 then 1 else 2 end + (cv > 0.2)::int + (heaviest / weight > 0.7)::int) + 1] as confidence from f"""
)
def blended_estimate(spark, d):
    scored = similarity.score_runs(_values(spark, _CURRENT), _candidates(spark, d))
    past = scored.where("id < 500").select(F.col("id").alias("seq"), "throughput", "has_context")
    return similarity.estimate(scored, past).select("n_matched", _r("context", 4), _r("ewma", 4), _r("alpha"), _r("blended", 4), _r("value", 4), "method", "confidence")


@query(f"with {_EST} select round(sum(weighted) / sum(weight), 4) as weighted_mean, round(max(heaviest) / sum(weight), 8) as dominance from m")
def weighted_estimate(spark, d):
    scored = similarity.score_runs(_values(spark, _CURRENT), _candidates(spark, d)).where("reason is null")
    w = F.col("score") * F.exp(-similarity.DECAY * F.col("age_days"))
    return scored.agg(F.round(F.sum(w * F.col("throughput")) / F.sum(w), 4).alias("weighted_mean"), F.round(F.max(w) / F.sum(w), 8).alias("dominance"))


_GROWTH = "select * from (values (1, 100, 100), (2, 100, 201), (3, 100, 200), (4, 0, 0), (5, 10, 0)) as t(id, a, b)"


@query(f"select id, greatest(a, b) > 0 and abs(a - b)::double / greatest(a, b, 1) > 0.5 as grown from ({_GROWTH})")
def row_growth_guard(spark, d):
    return _values(spark, _GROWTH).select("id", similarity.grown(F.col("a"), F.col("b")).alias("grown"))


@query("select event_id, (hour(ts) // 4)::int as band from events")
def time_bands(spark, d):
    return load(spark, d, "events").select("event_id", K.time_band(F.col("ts")).alias("band"))


@query(
    """select event_id, case when user_id % 100 = 0 then 'normal' when value / 500 < 0.2 then 'low' when value / 500 < 0.6 then 'normal' when value / 500 < 0.8 then 'high' else 'critical' end as load from events"""
)
def classify_load(spark, d):
    most = F.when(F.pmod("user_id", F.lit(100)) == 0, 0).otherwise(500)
    return load(spark, d, "events").select("event_id", K.source_load(F.col("value"), most).alias("load"))


@query("select event_id, case when value / 10 < 1 then 'excellent' when value / 10 < 5 then 'good' when value / 10 < 20 then 'degraded' else 'poor' end as network from events")
def classify_network(spark, d):
    return load(spark, d, "events").select("event_id", K.network_quality(F.col("value") / 10).alias("network"))


@query("select event_id, round(greatest(0, (epoch(timestamp '2024-02-01 00:00:00') - epoch(ts)) / 86400.0), 6) as age_days, case when (epoch(timestamp '2024-02-01 00:00:00') - epoch(ts)) > 86400 then true else false end as stale from events")
def profile_freshness(spark, d):
    age = K.age_days(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts"))
    return load(spark, d, "events").select("event_id", F.round(age, 6).alias("age_days"), (age > 1).alias("stale"))


@query("select 'events::' || user_id as key, sha256('events::' || user_id) as key_hash from (select distinct user_id from events)")
def object_key(spark, d):
    key = K.object_key(F.lit("events"), F.col("user_id").cast("string"))
    return load(spark, d, "events").select("user_id").distinct().select(key.alias("key"), F.sha2(key, 256).alias("key_hash"))


_SCHEMAS = """select 'orders' as name, sha256(string_agg(column_name, '|' order by column_name)) as names_hash, count(*) as n_columns from (describe orders)
  union all select 'events', sha256(string_agg(column_name, '|' order by column_name)), count(*) from (describe events)"""


@query(_SCHEMAS)
def schema_hash(spark, d):
    """Of the real columns; sinks.schema_hash covers their types, too, which the two engines name differently."""
    out = []
    for name in ("orders", "events"):
        columns = sorted(load(spark, d, name).columns)
        out.append((name, "|".join(columns), len(columns)))
    return spark.createDataFrame(out, "name string, names string, n_columns long").select("name", F.sha2("names", 256).alias("names_hash"), "n_columns")
