"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are exact token counts. Each source's target is its share of all tokens
by weight, at most ``REPEATS`` times its own size; what is over is shared again
by weight (water filling). A source takes every document as often as whole
passes fit its target. What remains is fitted on the histogram of document
sizes: a proportional part of every size first, then large sizes, then a
bounded-knapsack dynamic programme for the last ``FINE`` tokens. Documents of a
size are then chosen by a seeded hash.

Only the histogram (one row per source and size) meets in a task. Choosing by
hash goes over at most ``BUCKETS`` ranges of the hash per source and size, so
a size that a third of all documents share is never ranked as a whole.

Edge cases: a null source is a source of its own, the last; null or blank
text has size 0 and nothing is taken of it. A source without tokens has target
0. Rows with one id and text are chosen one by one, and so are rows with a null id; ties go by id. An empty table
gives an empty result; other columns aren't read. Results
depend on the rows and the seed alone, not on their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 17
FINE, BUCKETS, PER_BUCKET = 8192, 4096, 256


def fit_counts(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size to take for a total as near to budget, from below, as can be."""
    sizes = sorted((s for s in counts if s > 0), reverse=True)
    total = sum(s * counts[s] for s in sizes)
    if not total or budget <= 0:
        return {}
    budget = min(budget, total)
    take = {s: counts[s] * budget // total if budget > FINE else 0 for s in sizes}
    left = budget - sum(s * n for s, n in take.items())
    for s in sizes:
        more = min(counts[s] - take[s], max(0, left - FINE) // s)
        take[s] += more
        left -= more * s
    # Bounded knapsack: bit x of reach says that x tokens can be met; steps keep what each part adds.
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for s in sizes:
        spare = min(counts[s] - take[s], left // s)
        part = 1
        while spare > 0 and not reach >> left & 1:
            n = min(part, spare)
            steps.append((s, n, reach))
            reach |= (reach << (n * s)) & mask
            spare -= n
            part *= 2
    at = reach.bit_length() - 1
    for s, n, before in reversed(steps):
        if not before >> at & 1:
            take[s] += n
            at -= n * s
    return take


def source_targets(sizes: DataFrame) -> DataFrame:
    """key, source_size, target of rows (key, source, tokens): one row a source, so its windows are over sources only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    rows = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(REPEATS)) * F.col("tokens")).withColumn("all", F.sum("tokens").over(every).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("all") - before) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # The level rises with each source that is capped and falls after the first that isn't: its top is the water's.
    rows = rows.withColumn("water", F.max("level").over(every))
    return rows.select("key", F.col("tokens").alias("source_size"), F.least("cap", F.col("water") * F.col("w")).alias("target"))


def _plan(pdf):
    import pandas as pd

    counts = dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True))
    total, goal = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
    passes = min(REPEATS, goal // total) if total else 0
    take = fit_counts(counts, goal - passes * total) if passes < REPEATS else {}
    rows = [(pdf["key"].iloc[0], s, n, passes, take.get(s, 0), total, float(pdf["target"].iloc[0])) for s, n in counts.items()]
    return pd.DataFrame(rows, columns=["key", "size", "n", "passes", "extra", "source_size", "target"])


def row_hash(docs: DataFrame):
    """A hash of all columns."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, row, size, source_size, target, repeats, taken: one row per row.

    row is a hash of all columns of docs.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
        row_hash(docs).alias("row"),
    )
    sized = materialize(sized.withColumn("key", key), "mix-sizes")
    histogram = sized.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = materialize(histogram, "mix-histogram")
    targets = source_targets(histogram.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens")))
    plan = histogram.select("key", "size", "n").join(targets, "key").groupBy("key").applyInPandas(_plan, "key string, size long, n long, passes int, extra long, source_size long, target double")
    plan = plan.withColumn("bits", F.least(F.lit(BUCKETS.bit_length() - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PER_BUCKET)))).cast("int"))
    plan = materialize(plan, "mix-plan")

    rows = sized.join(plan, ["key", "size"])
    bucket = F.expr("case when bits = 0 then 0 else shiftrightunsigned(h, 64 - bits) end").cast("int")
    rows = materialize(rows.select("doc_id", "row", "key", "size", "h", "n", "passes", "extra", "source_size", "target", bucket.alias("bucket")), "mix-rows")
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    some = rows.where(part).groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("m"), F.first("extra").alias("want"))
    upto = F.sum("m").over(Window.partitionBy("key", "size").orderBy("bucket"))
    edges = some.withColumn("upto", upto).where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("m") < F.col("want")))
    edges = edges.select("key", "size", F.col("bucket").alias("edge"), (F.col("want") - F.col("upto") + F.col("m")).alias("room"))
    rows = rows.join(edges, ["key", "size"], "left")
    near = part & (F.col("bucket") == F.col("edge"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id"))
    ranked = rows.where(near).withColumn("rank", rank).withColumn("chosen", F.col("rank") <= F.col("room")).drop("rank")
    others = rows.where(~F.coalesce(near, F.lit(False))).withColumn("chosen", (F.col("extra") >= F.col("n")) & (F.col("n") > 0) | F.coalesce(part & (F.col("bucket") < F.col("edge")), F.lit(False)))
    out = ranked.unionByName(others).withColumn("repeats", F.col("passes") + F.col("chosen").cast("int"))
    return out.select("doc_id", "row", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def op10_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("repeats", "row")
