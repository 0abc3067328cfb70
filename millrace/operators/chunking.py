"""Range chunks of a key and their dispatch order, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST, ROWS = 200, 500_000


def range_chunks(stats: DataFrame, workers: int, row_bytes: int = 0, rows_each: int = ROWS) -> DataFrame:
    """stats (n_rows, pk_min, pk_max) -> chunk, lo, hi, est_rows, est_bytes of n = min(200, max(2 * workers, rows / rows_each, 1)) ranges.

    Bounds are whole numbers, halves to even; the last hi is pk_max + 1. A range
    of no width is one chunk.
    """
    flat = F.col("pk_max") <= F.col("pk_min")
    n = F.when(flat, F.lit(1)).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(2 * workers), F.floor(F.col("n_rows") / rows_each), F.lit(1)))).cast("int")
    frame = stats.where("pk_min is not null").select("*", n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    width = (F.col("pk_max") - F.col("pk_min")).cast("double") / F.col("n")
    lo = F.bround(F.col("pk_min") + F.col("chunk") * width).cast("long")
    hi = F.when(F.col("chunk") == F.col("n") - 1, F.col("pk_max") + 1).otherwise(F.bround(F.col("pk_min") + (F.col("chunk") + 1) * width).cast("long"))
    est = F.floor(F.col("n_rows") / F.col("n")).cast("long")
    return frame.select("chunk", lo.alias("lo"), hi.cast("long").alias("hi"), est.alias("est_rows"), (est * row_bytes).alias("est_bytes"))


def located(df: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """_k and the chunk that holds it (null: none), for each row of df.

    The bounds are one row of at most 200 numbers, broadcast; a key's chunk is
    found by dividing, then moved by one at most for the bounds' rounding, so a
    row costs the same whatever the number of chunks.
    """
    frame = chunks.agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("b"))
    rows = df.select(F.col(key).alias("_k")).join(F.broadcast(frame))
    n, low = F.size("b"), F.get("b", F.lit(0))["lo"]
    width = (F.get("b", n - 1)["hi"] - low).cast("double") / n
    guess = F.greatest(F.lit(0), F.least(n - 1, F.floor((F.col("_k") - low) / F.greatest(width, F.lit(1e-9))).cast("int")))
    rows = rows.select("_k", "b", guess.alias("_g"))
    at = F.when(F.col("_k") < F.get("b", F.col("_g"))["lo"], F.col("_g") - 1).when(F.col("_k") >= F.get("b", F.col("_g"))["hi"], F.col("_g") + 1).otherwise(F.col("_g"))
    rows = rows.select("_k", "b", at.alias("_g"))
    held = (F.col("_k") >= F.get("b", F.col("_g"))["lo"]) & (F.col("_k") < F.get("b", F.col("_g"))["hi"])
    return rows.select("_k", F.when(held, F.col("_g")).alias("chunk"))


def counted(df: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """Chunks with the rows that they hold; counts are combined before the shuffle."""
    counts = located(df, key, chunks).where("chunk is not null").groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"))
    return chunks.join(counts, "chunk", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def reassembly(df: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """Whether the chunks together are the table: rows of the table, rows of all chunks, chunks that begin before the one before ends."""
    rows = located(df, key, chunks).agg(F.count(F.lit(1)).alias("table_rows"), F.count("chunk").alias("chunk_rows"))
    before = F.lag("hi").over(Window.orderBy("lo"))
    overlaps = chunks.select((F.col("lo") < before).alias("o")).agg(F.coalesce(F.sum(F.col("o").cast("long")), F.lit(0)).alias("overlaps"))
    return rows.join(F.broadcast(overlaps))


def schedule(chunks: DataFrame, size: str = "n_rows") -> DataFrame:
    """dispatch: largest first, ties by chunk number. At most 200 rows."""
    return chunks.withColumn("dispatch", F.row_number().over(Window.orderBy(F.col(size).desc(), "chunk")))
