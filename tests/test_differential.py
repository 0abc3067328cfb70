"""Every registered engine query against its reference SQL in DuckDB."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from millrace.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(v):
    if isinstance(v, (int, Decimal)) and not isinstance(v, bool):
        v = float(v)
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    got = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    expected = sorted(tuple(_plain(r[i]) for i in order) for r in got.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in df.select(*sorted(names)).collect()) == expected


@pytest.mark.parametrize("name", ["directional_counts", "escape_check"])
def test_same_rows_with_zero_and_missing_throughput(spark, tmp_path, name):
    """All ways in which five runs can have throughput 0, none, a low or a high one."""
    folder, c = str(tmp_path), duckdb.connect()
    c.execute("create table v as select i::bigint as i, case i when 0 then 0.0 when 2 then 4.0 when 3 then 10.0 end::double as value from range(4) r(i)")
    c.execute(
        f"""copy (select u * 5 + t as event_id, timestamp '2024-01-01' + t * interval 1 hour as ts, u as user_id, 'click' as event_type, value, '' as props
  from range(1024 + 20) a(u), range(5) b(t) join v on i = u // (4 ** t)::bigint % 4 where u < 1024 or t < u % 5) to '{folder}/events.parquet' (format parquet)"""
    )
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    got = c.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    expected = sorted(tuple(map(_plain, r)) for r in got.fetchall())
    assert len(expected) > 700
    assert sorted(tuple(map(_plain, r)) for r in catalog.QUERIES[name](spark, folder).select(*names).collect()) == expected


def test_escape_check_rounds_as_its_sql(spark, tmp_path):
    c = duckdb.connect()
    c.execute(
        f"""copy (select i as event_id, timestamp '2024-01-01' + i * interval 1 hour as ts, 1::bigint as user_id, 'click' as event_type, v::double as value
  from (values (1::bigint, 12.05), (2, 6.4), (3, 57.63), (4, 26.12)) t(i, v)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert [tuple(r) for r in catalog.QUERIES["escape_check"](spark, str(tmp_path)).collect()] == c.execute(catalog.ORACLES["escape_check"]).fetchall()


def test_entry_has_all_queries_and_matching_oracles():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
