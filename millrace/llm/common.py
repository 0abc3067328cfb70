"""Shared parts of the corpus operators: tables, scratch storage, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named: the warehouse, which all machines share, or on one machine a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        root = spark.conf.get("spark.sql.warehouse.dir")
    if not root:
        root = getattr(spark, "_millrace_scratch", None)
        if root is None:
            root = spark._millrace_scratch = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def named_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(d, text) of the rows with an id and a text, and (d, doc_id) where d isn't the id itself.

    d (long) names a text: its id, but where one id has different texts a hash of
    both, so that each text is a document of its own. Without such ids there are no names.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = texts.select("doc_id", F.xxhash64("text").alias("t")).groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    several = materialize(h.where("low <> high").select("doc_id"), "several-texts")
    if several.isEmpty():
        return texts.select(F.col("doc_id").alias("d"), "text"), None
    marked = texts.join(several.withColumn("_several", F.lit(True)), "doc_id", "left")
    marked = marked.select("doc_id", F.when(F.col("_several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("d"), "text")
    names = materialize(marked.select("d", "doc_id").distinct(), "names")
    return marked.select("d", "text"), names


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, component): every node with the least node it reaches.

    Alternating large-star and small-star rounds; each is an aggregate with
    map-side combine and a join that adaptive execution can split, so a hub
    with a third of all edges is no single task. Null ends and loops are
    dropped; a node without other edges isn't returned.
    """
    edges = materialize(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )

    def digest(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = digest(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = digest(new)
        discard(edges)
        edges = new
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
