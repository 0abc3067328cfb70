"""The corpus pipeline: rows of documents to clean, mixed, encoded documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

In all stages rows are told apart by id and text (mixing: by all columns), so of
one id's different texts each has a verdict of its own, and rows with a null id
are judged by their text. Rows that are equal in everything are treated alike.
Extra columns, whatever their names, pass through. Empty tables stay empty. Texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import lines, minhash, mixing, pieces, quality
from millrace.llm.common import WORD, discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go; null and blank texts fail the base rules."""
    verdicts = quality.quality(docs)
    rejected = materialize(verdicts.where("not kept").select("row").distinct(), "rejected")
    marked = docs.withColumn("_row", quality.row_key(docs))
    return marked.join(rejected.select(F.col("row").alias("_row")).hint("merge"), "_row", "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all texts but the first; a document that loses its last word so goes too.

    Null texts and rows with a null id stay as they are.
    """
    out = lines.without_duplicate_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the first by id and text hash.

    Stages on word shingles take five words and a similarity of 0.8; the query op5 has limits of its own. Rows
    repeated with one id and text become one. Texts without words, and rows with a null id, stay.
    """
    groups = minhash.near_duplicates(docs, k=5, percent=80).where("doc_id is not null and t is not null")
    rows = groups.groupBy("node", "doc_id", "t").agg(F.count(F.lit(1)).alias("rows"))
    heads = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    first = F.coalesce(F.struct("doc_id", "t") == F.col("head"), F.lit(True))
    marks = rows.join(heads, "node", "left").select("doc_id", "t", first.alias("first"), "rows")
    marks = materialize(marks.where("not first or rows > 1").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "first"), "near-marks")
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    out = keyed.join(marks.where("not first").hint("merge"), ["_id", "_t"], "left_anti")
    again = marks.where("first")
    if again.isEmpty():
        return out.select(*docs.columns)
    once = out.join(again.hint("merge"), ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"])
    return out.join(again.hint("merge"), ["_id", "_t"], "left_anti").unionByName(once).select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times; of equal rows together as often as of all of them."""
    counted = mixing.mix(docs).groupBy(F.col("row").alias("_row")).agg(F.sum("repeats").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0")
    counted = materialize(counted, "repeats")
    rows = docs.withColumn("_row", mixing.row_hash(docs)).join(counted.hint("merge"), "_row")
    times = lambda n: F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias("_copy")
    out = rows.select(*docs.columns, times(F.floor(F.col("_all") / F.col("_rows")))).select(*docs.columns)
    uneven = F.col("_all") % F.col("_rows")
    if counted.where(uneven > 0).isEmpty():
        return out
    rest = rows.where(uneven > 0).dropDuplicates(["_row"]).select(*docs.columns, times(uneven)).select(*docs.columns)
    return out.unionByName(rest)


def sentencepiece_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids; a null text has none."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing_to_targets", mixing_to_targets),
    ("sentencepiece_coding", sentencepiece_coding),
]

#: SQL can't express the outlier estimates, the edit join's groups or the pieces; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
