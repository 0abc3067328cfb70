"""Quality rules: counted base rules and robust multivariate outliers.

Base rules count words, symbols, repeated lines and repeated three-word
windows over whole texts. Texts that pass them give a vector of transformed
statistics. For each language and source a minimum-covariance-determinant
estimate is sought: the ``SUPPORT`` share of rows whose scatter has the least
determinant. Concentration steps run from ``STARTS`` starts (medians and median
deviations, and the moments of small seeded subsets), each start for ``STEPS`` steps;
the one with the least determinant goes on until its determinant stands still. Texts
beyond the chi-square quantile of 1 - ``TAIL`` are rejected; scatter is scaled so that the median distance is that of a
normal sample. Real statistics have longer tails than normal ones, which is why ``TAIL`` is small.

Every concentration step is one aggregate over all rows, for all starts: moments are summed
per group, start and bin of log distance, so a step's cut and its new estimate
both come from at most ``BINS`` rows a group and start, whatever the group's size; the bin in
which the cut lies counts in part. Nothing
is sampled but the starts; a hot group costs no more than map-side combined sums.

Edge cases: null text counts as no words and fails the base rules. A null
language or source is a group of its own. Groups of fewer than ``LEAST`` texts
are pooled within their language, then over all; a pool still smaller gives
no verdict and its texts stay. Equal rows get equal verdicts. Constant
statistics can't make a scatter singular: each variance has a floor, and correlations
are shrunk by ``SHRINK``. An empty table gives an empty result; other columns aren't read.
Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, table

SUPPORT, LEAST, STEPS, BINS = 0.75, 50, 4, 640
#: Starts, rows of a seeded start, the most steps of the best, and by how much correlations are shrunk.
STARTS, SUBSET, MOST_STEPS, SHRINK = 8, 15, 10, 0.005
#: The share of a normal sample beyond the limit.
TAIL = 1e-9


def chi_square_limit(tail: float) -> float:
    """The squared distance beyond which that share of a normal sample in five dimensions lies."""
    beyond = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > tail else (low, middle)
    return (low + high) / 2


LIMIT = chi_square_limit(TAIL)
#: The least standard deviation of each statistic.
FLOOR = np.array([0.25, 0.05, 0.6, 0.5, 0.06])
P = len(FLOOR)
#: The median of chi-square with five degrees of freedom.
CHI_MEDIAN = chi_square_limit(0.5)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(marks: np.ndarray, o: np.ndarray) -> np.ndarray:
    at = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=at[1:])
    return at[o[1:]] - at[o[:-1]]


def repeated_words(h: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """Words of each text that lie in a k-word window found twice or more in it."""
    n = len(first) - 1
    if len(h) < k:
        return np.zeros(n, np.int64)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    g = (row[: len(h) - k + 1] << np.uint64(52)) | (W.grams(h, k) >> np.uint64(12))
    whole = row[: len(g)] == row[k - 1 :]
    s = np.sort(g[whole])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    cover = np.zeros(len(h), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
        hit = np.flatnonzero((twice[at] == g) & whole)
        for i in range(k):
            cover[hit + i] = True
    return _per_text(cover, first)


def repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, b, o in W.slices(batch.column("text")):
            start, end, first = W.spans(b, o)
            counts = [
                np.diff(first),
                _per_text(W._NONWS[b] & ((b & 0xC0) != 0x80), o),
                _per_text(_SYMBOL[b], o),
                np.array([repeated_lines(b[o[x] : o[x + 1]].tobytes()) for x in range(j - i)], np.int64),
                repeated_words(W.hashes(b, start, end, fold=False), first),
            ]
            keep = [batch.column(c).slice(i, j - i) for c in ("doc_id", "row", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c.astype(np.int64)) for c in counts)], ["doc_id", "row", "lang", "source", *STATS])


def row_key(docs: DataFrame):
    """A hash of what a verdict hangs on, and the id."""
    return F.xxhash64(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("lang", "source", "text")))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row (its key), lang, source and the five counts of each row's whole text."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return some.mapInArrow(W.tidy(_stats), "doc_id long, row long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def features() -> list:
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return [F.log(n), F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / n)]


_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = [f"s{i}" for i in range(P)] + [f"c{i}_{j}" for i, j in _PAIRS]
#: Files of a table of models.
FILES = 4
#: Bins of each doubling of the distance.
PER_OCTAVE = 16
_BY = ["lang_key", "source_key"]
_MODEL = "lang_key string, source_key string, start int, seen long, logdet double, model array<double>"
_RESULT = pa.schema([(c, pa.string()) for c in _BY] + [("start", pa.int32()), ("seen", pa.int64()), ("logdet", pa.float64()), ("model", pa.list_(pa.float64()))])


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    at = np.cumsum(weights)
    return float(values[np.searchsorted(at, at[-1] / 2)])


def _estimate(mean: np.ndarray, cov: np.ndarray) -> tuple[float, list[float]]:
    """Log determinant and model (location, inverse scatter, scale 1) of moments, floors applied."""
    # Numbers summed in another order differ in their last bits; rounding hides that.
    mean, cov = np.round(mean, 9), np.round(cov, 9)
    var = np.maximum(np.diag(cov), FLOOR**2)
    cov = cov * (1 - SHRINK)
    np.fill_diagonal(cov, var)
    return round(float(np.linalg.slogdet(cov)[1]), 6), [*mean.tolist(), *np.round(np.linalg.inv(cov), 7).ravel().tolist(), 1.0]


def _row(group: pa.Table, start: int, seen: int, logdet: float, model: list[float]) -> pa.Table:
    values = [*(group[c][0].as_py() for c in _BY), start, seen, logdet, model]
    return pa.table([[x] for x in values], schema=_RESULT)


def _by_bin(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """group in the order of its bins, the bins and their counts."""
    group = group.sort_by("bin")
    return group, group["bin"].to_numpy(), group["n"].to_numpy()


def _medians(group: pa.Table) -> pa.Table:
    """The first start: medians and median deviations of the binned statistics."""
    mean, dev, seen = np.zeros(P), np.zeros(P), 0
    group, bins, counts = _by_bin(group)
    which = group["i"].to_numpy()
    for i in np.unique(which):
        v, w = bins[which == i] / 64.0, counts[which == i]
        mean[i] = _median(v, w)
        apart = np.abs(v - mean[i])
        order = np.argsort(apart, kind="stable")
        dev[i] = 1.4826 * _median(apart[order], w[order])
        seen = int(w.sum())
    return _row(group, 0, seen, *_estimate(mean, np.diag(dev**2)))


def _moments(sums: dict[str, float], m: float) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([sums[f"s{i}"] / m for i in range(P)])
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = sums[f"c{i}_{j}"] / m - mean[i] * mean[j]
    return mean, cov


def _subset(group: pa.Table) -> pa.Table:
    """A seeded start: the moments of a few rows."""
    one = group.slice(0, 1).to_pylist()[0]
    return _row(group, one["start"], one["n"], *_estimate(*_moments(one, float(one["n"]))))


def _concentrate(group: pa.Table) -> pa.Table:
    """One step: the nearest SUPPORT of the rows give the next location and scatter; the last bin counts in part."""
    group, _, counts = _by_bin(group)
    n = counts.astype(float)
    upto = np.cumsum(n)
    need = SUPPORT * upto[-1]
    share = np.clip((need - (upto - n)) / n, 0, 1)
    sums = {c: float((group[c].to_numpy() * share).sum()) for c in _SUMS}
    return _row(group, group["start"][0].as_py(), int(upto[-1]), *_estimate(*_moments(sums, need)))


def _scale(group: pa.Table) -> pa.Table:
    """The last element of a model: what makes the median distance that of a normal sample."""
    group, bins, counts = _by_bin(group)
    middle = 2.0 ** (_median(bins + 0.5, counts) / PER_OCTAVE)
    model = group["model"][0].as_py()
    model[-1] = max(1.0, middle / CHI_MEDIAN)
    return _row(group, 0, int(counts.sum()), 0.0, model)


def _distance():
    d = [F.col(x) - F.col("model")[i] for i, x in enumerate(_X)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + d[i] * d[j] * F.col("model")[P + i * P + j] * (1.0 if i == j else 2.0)
    return total / F.col("model")[P + P * P]


def _bin():
    return F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.floor(PER_OCTAVE * F.log2(F.greatest(_distance(), F.lit(1e-12)))))).cast("int").alias("bin")


def _kept(models: DataFrame) -> DataFrame:
    """models, a row a group and start, written as few files; only these rows are dealt anew, not what they come from."""
    return materialize(models.repartition(FILES), "mcd")


def robust_models(rows: DataFrame) -> DataFrame:
    """lang_key, source_key, seen, model: the estimate of each fit group of rows with x0..x4."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in _PAIRS]
    binned = rows.select(*_BY, F.posexplode(F.array(*_X)).alias("i", "x")).groupBy(*_BY, "i", F.floor(F.col("x") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    models = binned.groupBy(*_BY).applyInArrow(_medians, _MODEL)
    # Rows of the seeded starts: a share of each group by a hash of the row, so equal rows go together.
    sizes = rows.groupBy(*_BY).agg(F.count(F.lit(1)).alias("size"))
    drawn = rows.join(sizes, _BY).select(*_BY, *_X, "size", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))).alias("start"))
    drawn = drawn.where(F.pmod(F.xxhash64("start", *_X), F.col("size")) < SUBSET).groupBy(*_BY, "start").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") > P)
    models = _kept(models.unionByName(drawn.groupBy(*_BY, "start").applyInArrow(_subset, _MODEL)))

    def step(models: DataFrame) -> DataFrame:
        near = rows.join(models.select(*_BY, "start", "model"), _BY).groupBy(*_BY, "start", _bin()).agg(F.count(F.lit(1)).alias("n"), *sums)
        return _kept(near.groupBy(*_BY, "start").applyInArrow(_concentrate, _MODEL))

    for _ in range(STEPS):
        models = step(models)
    best = models.groupBy(*_BY).agg(F.min(F.struct("logdet", "start")).alias("best"))
    models = _kept(models.join(best, _BY).where((F.col("start") == F.col("best.start"))).drop("best"))
    for _ in range(MOST_STEPS):
        after = step(models)
        moved = after.join(models.select(*_BY, F.col("logdet").alias("was")), _BY).where(F.abs(F.col("logdet") - F.col("was")) > 1e-4)
        models = after
        if moved.isEmpty():
            break
    spread = rows.join(models.select(*_BY, "model"), _BY).groupBy(*_BY, "model", _bin()).agg(F.count(F.lit(1)).alias("n"))
    return _kept(spread.groupBy(*_BY).applyInArrow(_scale, _MODEL))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, row, the counts, base_failed, distance (null without a verdict) and kept of each row of docs."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(text_statistics(docs).withColumn("base_failed", base), "quality")
    keys = stats.select("*", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("l"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("s"))
    passed = keys.where(~F.col("base_failed"))
    sizes = passed.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.where(F.col("n") < LEAST).groupBy("l").agg(F.sum("n").alias("pool"))
    fit = sizes.join(rest, "l", "left").select(
        "l",
        "s",
        F.when((F.col("n") >= LEAST) | (F.col("pool") >= LEAST), F.col("l")).otherwise("*").alias("lang_key"),
        F.when(F.col("n") >= LEAST, F.col("s")).otherwise("*").alias("source_key"),
    )
    fit = materialize(fit, "mcd-groups")
    rows = passed.join(fit, ["l", "s"]).select("lang_key", "source_key", *(x.alias(n) for x, n in zip(features(), _X, strict=True)))
    rows = materialize(rows, "mcd-rows")
    models = robust_models(rows).where(F.col("seen") >= LEAST).select("lang_key", "source_key", "model")
    out = keys.join(fit, ["l", "s"], "left").join(models, ["lang_key", "source_key"], "left")
    ok = F.when(F.col("base_failed"), F.lit(None)).otherwise(F.lit(0))
    out = out.select("*", *(F.when(ok.isNotNull(), x).alias(n) for x, n in zip(features(), _X, strict=True)))
    out = out.withColumn("distance", _distance())
    return out.select("doc_id", "row", *STATS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= LIMIT, F.lit(True))).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("row")
