"""Database connectors: JDBC options by kind, metadata with its rules, chunked reads, latency, a registry."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.plans.model import ValidationError
from millrace.sources import scans

BATCH = 10_000


@dataclass(frozen=True)
class Kind:
    """What differs between databases."""

    name: str
    driver: str
    port: int
    url: str
    quote: str = '"'
    #: Statement that opens a consistent snapshot; each Spark partition has a snapshot of its own.
    snapshot: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    #: Statements of the system catalog, each of one row; {schema} and {table} are the table's. Estimated rows and bytes
    #: (and the storage engine), the key's columns (name), and the most and the open connections.
    facts: str | None = None
    keys: str | None = None
    connections: str | None = None
    schema: str = ""


KINDS = {
    "postgresql": Kind(
        "postgresql", "org.postgresql.Driver", 5432, "jdbc:postgresql://{host}:{port}/{database}", snapshot="SET SESSION CHARACTERISTICS AS TRANSACTION ISOLATION LEVEL REPEATABLE READ", schema="public",
        facts="select cast(c.reltuples as bigint) as n_rows, pg_total_relation_size(c.oid) as size, 'heap' as engine from pg_class c join pg_namespace n on n.oid = c.relnamespace where n.nspname = '{schema}' and c.relname = '{table}'",
        keys="select a.attname as name from pg_index i join pg_class c on c.oid = i.indrelid join pg_namespace n on n.oid = c.relnamespace join pg_attribute a on a.attrelid = c.oid and a.attnum = any(i.indkey) where i.indisprimary and n.nspname = '{schema}' and c.relname = '{table}'",
        connections="select cast(current_setting('max_connections') as int) as most, cast(count(*) as int) as active from pg_stat_activity where state = 'active'",
    ),
    "mysql": Kind(
        "mysql", "com.mysql.cj.jdbc.Driver", 3306, "jdbc:mysql://{host}:{port}/{database}?characterEncoding=utf8mb4&useCursorFetch=true", quote="`", snapshot="START TRANSACTION WITH CONSISTENT SNAPSHOT",
        facts="select table_rows as n_rows, data_length + index_length as size, engine as engine from information_schema.tables where table_schema = '{schema}' and table_name = '{table}'",
        keys="select column_name as name from information_schema.key_column_usage where constraint_name = 'PRIMARY' and table_schema = '{schema}' and table_name = '{table}'",
        connections="select @@max_connections as most, count(*) as active from information_schema.processlist where command <> 'Sleep'",
    ),
    "sqlserver": Kind(
        "sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433, "jdbc:sqlserver://{host}:{port};databaseName={database}", snapshot="SET TRANSACTION ISOLATION LEVEL SNAPSHOT", schema="dbo",
        facts="select sum(case when s.index_id in (0, 1) then s.row_count else 0 end) as n_rows, sum(s.reserved_page_count) * 8192 as size, 'rowstore' as engine from sys.dm_db_partition_stats s where s.object_id = object_id('{schema}.{table}')",
        keys="select c.name as name from sys.indexes i join sys.index_columns x on x.object_id = i.object_id and x.index_id = i.index_id join sys.columns c on c.object_id = x.object_id and c.column_id = x.column_id where i.is_primary_key = 1 and i.object_id = object_id('{schema}.{table}')",
        connections="select case when @@max_connections = 0 then 32767 else @@max_connections end as most, count(*) as active from sys.dm_exec_sessions where is_user_process = 1 and status = 'running'",
    ),
    "derby": Kind(
        "derby", "org.apache.derby.iapi.jdbc.AutoloadedDriver", 0, "jdbc:derby:{database}", schema="APP",
        # Derby's catalog tells a key by its index's descriptor, "... (1)" for the first column alone.
        keys="select c.columnname as name from sys.sysconstraints k join sys.syskeys y on y.constraintid = k.constraintid join sys.sysconglomerates g on g.conglomerateid = y.conglomerateid join sys.systables t on t.tableid = k.tableid join sys.sysschemas s on s.schemaid = t.schemaid join sys.syscolumns c on c.referenceid = t.tableid where k.type = 'P' and s.schemaname = '{schema}' and t.tablename = '{table}' and (cast(g.descriptor as varchar(1000)) like '%(' || trim(cast(c.columnnumber as char(5))) || ')%' or cast(g.descriptor as varchar(1000)) like '%(' || trim(cast(c.columnnumber as char(5))) || ',%' or cast(g.descriptor as varchar(1000)) like '%, ' || trim(cast(c.columnnumber as char(5))) || ')%' or cast(g.descriptor as varchar(1000)) like '%, ' || trim(cast(c.columnnumber as char(5))) || ',%')",
    ),
}


class Connector:
    """One table of a source; file sources and databases have the same methods."""

    def metadata(self) -> dict[str, Any]:
        raise NotImplementedError

    def read(self, bounds: list[tuple] | None = None, snapshot: bool = False) -> DataFrame:
        """Rows, all or within key bounds; snapshot asks a database for a consistent view."""
        raise NotImplementedError

    def connections(self) -> tuple[int, int] | None:
        """The most and the open connections of the source; None where it has no such limit or doesn't tell."""
        return None

    def latency(self, probes: int = 5) -> dict[str, float]:
        """Milliseconds of one-row reads: the middle, the largest, the first, and how many."""
        took = []
        for _ in range(probes):
            began = time.perf_counter()
            self.read().limit(1).collect()
            took.append((time.perf_counter() - began) * 1000)
        ordered = sorted(took)
        return {"p50_ms": round(ordered[len(ordered) // 2], 2), "p95_ms": round(ordered[-1], 2), "connection_ms": round(took[0], 2), "samples": probes}


class FileTable(Connector):
    """Parquet or CSV files; they don't change, so every chunk sees the same rows."""

    def __init__(self, spark: SparkSession, config: dict[str, Any], table: str, key: str | None):
        self.spark, self.key = spark, key
        path, self.kind = config["path"], config.get("format", "parquet")
        full = f"{path}/{table}.{self.kind}" if not path.endswith(self.kind) else path
        self.df = spark.read.parquet(full) if self.kind == "parquet" else spark.read.option("header", True).csv(full)

    def read(self, bounds=None, snapshot=False):
        if bounds is None or not self.key:
            return self.df
        return self.df.where(" or ".join(f"({p})" for p in scans.range_predicates(self.key, bounds)).replace('"', "`"))

    def metadata(self):
        size = self.df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct().agg(F.sum("s")).first()[0] or 0
        return _described(self.df, self.key, size)


class JdbcTable(Connector):
    """A database table through JDBC; needs the database's driver on the class path."""

    def __init__(self, spark: SparkSession, kind: str, config: dict[str, Any], table: str, key: str | None):
        self.spark, self.kind, self.config, self.table, self.key = spark, KINDS[kind], config, table, key

    @property
    def url(self) -> str:
        c = self.config
        return c.get("url") or self.kind.url.format(host=c.get("host", "localhost"), port=c.get("port", self.kind.port), database=c["database"])

    def options(self, snapshot: bool = False) -> dict[str, str]:
        out = {"driver": self.kind.driver, "fetchsize": str(BATCH), **self.kind.options}
        out |= {k: str(self.config[k]) for k in ("user", "password") if k in self.config}
        if snapshot and self.kind.snapshot:
            out["sessionInitStatement"] = self.kind.snapshot
        return out

    def read(self, bounds=None, snapshot: bool = False):
        properties = self.options(snapshot)
        if bounds is None or not self.key:
            return self.spark.read.jdbc(self.url, self.table, properties=properties)
        return scans.jdbc_chunks(self.spark, self.url, self.table, self.key, bounds, properties)

    def _catalog(self, statement: str | None) -> list[dict[str, Any]]:
        """Rows of a catalog statement for this table, their names in lower case."""
        if not statement:
            return []
        schema, _, name = self.table.rpartition(".")
        text = statement.format(schema=(schema or self.config.get("schema") or self.kind.schema or self.config.get("database", "")).replace("'", "''"), table=name.replace("'", "''"))
        rows = self.spark.read.format("jdbc").options(url=self.url, **{k: v for k, v in self.options().items() if k != "sessionInitStatement"}).option("dbtable", f"({text}) q").load().collect()
        return [{k.lower(): v for k, v in r.asDict().items()} for r in rows]

    def connections(self):
        rows = self._catalog(self.kind.connections)
        return (int(rows[0]["most"]), int(rows[0]["active"])) if rows else None

    def metadata(self):
        """Columns, count, size and key bounds, from the catalog where it tells.

        The key is the one given, or the table's primary key. Refused: a table without a single-column key, as its chunks couldn't
        be told apart, and one whose storage has no consistent snapshots.
        """
        keys = [r["name"] for r in self._catalog(self.kind.keys)] if not self.key else [self.key]
        if len(keys) != 1:
            raise ValidationError(f"{self.table} needs a single-column key" + (f", not {', '.join(sorted(keys))}" if keys else ""))
        self.key = keys[0]
        facts = next(iter(self._catalog(self.kind.facts)), {})
        if self.kind.name == "mysql" and facts and str(facts["engine"]).lower() != "innodb":
            raise ValidationError(f"{self.table} is stored by {facts['engine']}; only InnoDB reads consistently")
        df = self.read()
        out = _described(df, self.key, int(self.config.get("size_bytes") or facts.get("size") or 0))
        if not out["size"]:  # a width by type, so that a large table is never taken for a small one
            out["size"] = out["n_rows"] * sum(df.sparkSession._jvm.org.apache.spark.sql.types.DataType.fromJson(f.dataType.json()).defaultSize() for f in df.schema.fields)
        return out | {"estimated_rows": facts.get("n_rows")}


def _described(df: DataFrame, key: str | None, size: int) -> dict[str, Any]:
    if key is not None and key not in df.columns:
        raise ValidationError(f"no column {key}")
    stats = profile.key_stats(df, key).first() if key else df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(None).alias("pk_min"), F.lit(None).alias("pk_max")).first()
    return {"n_rows": stats["n_rows"], "size": int(size), "columns": [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "key": key, "pk_min": stats["pk_min"], "pk_max": stats["pk_max"]}


def connect(spark: SparkSession, source_type: str, config: dict[str, Any], table: str, key: str | None = None) -> Connector:
    if source_type in KINDS:
        return JdbcTable(spark, source_type, config, table, key)
    if source_type in ("parquet", "csv"):
        return FileTable(spark, config | {"format": source_type}, table, key)
    raise ValidationError(f"no connector for {source_type!r}")
