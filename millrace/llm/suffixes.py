"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected positions are kept: minimisers of 16-word
grams over windows of ``LEAST`` - 15 grams, so two texts that share ``LEAST`` words
in a row keep a suffix at the same place of them. Suffixes whose 16-gram
occurs once go by a count. The others carry hashes of the words after them and
before them, are sorted over the whole cluster, and compared with their
next ``NEIGHBOURS`` neighbours: equal words to the right and to the left give the passage. A longer
passage holds several kept suffixes; their ranges join.

A 16-gram in at most ``NEIGHBOURS`` + 1 places has all its places compared so. For
a more frequent one, places that share words on both sides can stand farther
apart; there every window of ``LEAST`` words whose minimiser the place is gives
its hash, and windows found in two places or more are passages as well. So every
run of ``LEAST`` words or more found twice is found, however frequent its parts are.

Sorting deals by (suffix, document, position), so equal suffixes, however many,
spread over tasks; rows at the edges of tasks (a few a task) are compared in
another small step. Comparing with neighbours is linear in the rows. Windows are
counted with map-side combine. Words are compared by 32-bit hashes: a range can
end one word late with probability 2 ** -32 a comparison.

Edge cases: null or blank text, and texts of fewer than ``LEAST`` words, have no
passage. A null id takes no part and isn't returned. Rows repeated with one id
count as repeats of their words; different texts of one id are documents of their own and
give a row each. Ties go by id and position. An empty table gives an empty result; other
columns aren't read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import connected_components, discard, materialize, named_texts, table
from .seeds import over_neighbours, seed_rows

LEAST, GRAM = 50, 16
#: Words to the right and to the left that a suffix carries, neighbours it meets, bytes of a word's code.
RIGHT, LEFT, NEIGHBOURS, CODE = LEAST, LEAST - GRAM, 6, 4
_COLS = ["h", "d", "pos", "right", "left"]
_ROW = "h long, d long, pos int, right binary, left binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text, at array<struct<pos, h>>) -> suffix rows; a context is CODE bytes a word, 0 past the text's ends."""
    for batch in batches:
        lists = batch.column(2)
        for i, j, b, o in W.slices(batch.column(1), rows=512):
            start, end, first = W.spans(b, o)
            code = (W.hashes(b, start, end, fold=False) >> np.uint64(32)).astype(np.uint32)
            code[code == 0] = 1
            part = lists.slice(i, j - i)
            offs = np.asarray(part.offsets)
            inner = part.flatten()
            pos, h = (np.asarray(inner.field(c)) for c in (0, 1))
            doc = np.repeat(np.arange(j - i), np.diff(offs))
            for lo in range(0, len(pos), 20_000):
                p, d = pos[lo : lo + 20_000].astype(np.int64), doc[lo : lo + 20_000]
                at = first[d] + p
                ahead = at[:, None] + np.arange(RIGHT)
                right = np.where(ahead < first[d + 1][:, None], code[np.minimum(ahead, len(code) - 1)], 0).astype(">u4")
                back = at[:, None] - 1 - np.arange(LEFT)
                left = np.where(back >= first[d][:, None], code[np.maximum(back, 0)], 0).astype(">u4")
                ids = batch.column(0).slice(i, j - i).take(pa.array(d))
                binary = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (right, left)]
                yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + 20_000]), ids, pa.array(p.astype(np.int32)), *binary], _COLS)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words from the first on, of rows of codes; 0 equals nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _codes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), width).astype(np.uint32)


def compare(rows: pa.Table) -> pa.RecordBatch:
    """d, start, end, other for each side of all neighbours of a sorted run that share LEAST words or more."""
    h, doc, pos = (np.asarray(rows.column(c)) for c in ("h", "d", "pos"))
    right, left = _codes(rows.column("right"), RIGHT), _codes(rows.column("left"), LEFT)
    out = [np.zeros((4, 0), np.int64)]
    for shift in range(1, min(NEIGHBOURS, len(h) - 1) + 1):
        at = np.flatnonzero(h[shift:] == h[:-shift])
        if not len(at):
            break
        a, b = at, at + shift
        n_right, n_left = _same(right[a], right[b]), _same(left[a], left[b])
        ok = n_right + n_left >= LEAST
        a, b, n_right, n_left = a[ok], b[ok], n_right[ok], n_left[ok]
        for x, y in ((a, b), (b, a)):
            out.append(np.stack([doc[x], pos[x] - n_left, pos[x] + n_right, doc[y]]).astype(np.int64))
    found = np.unique(np.concatenate(out, axis=1), axis=1)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(found, kinds, strict=True)], ["d", "start", "end", "other"])


def frequent_windows(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """d, start, end, other of the windows of LEAST words around frequent suffixes that are found in two places or more.

    seeds (h, d, pos, before, number) of 16-grams too frequent for neighbours alone.
    """
    # The first window begins before words before pos, the last number - 1 words later.
    wide = rows.join(seeds, ["h", "d", "pos"]).select("*", F.explode(F.sequence(F.col("before"), F.col("before") - F.col("number") + 1, F.lit(-1))).alias("back"))
    words_of = lambda c, n: F.substring(F.col(c), F.lit(1), CODE * n)
    key = F.xxhash64("h", "back", words_of("left", F.col("back")), words_of("right", LEAST - F.col("back")))
    windows = materialize(wide.select(key.alias("key"), "d", (F.col("pos") - F.col("back")).alias("start")), "suffix-windows")
    first = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).where("n > 1")
    both = windows.join(first.select("key", "least", "most").hint("merge"), "key")
    other = F.when(F.col("d") != F.col("least"), F.col("least")).otherwise(F.col("most"))
    return both.select("d", "start", (F.col("start") + LEAST).alias("end"), other.alias("other"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, covered, spans, component_id of the documents with passages of LEAST words or more found elsewhere.

    spans are word ranges [start, end), each with the least other document among its
    partners (null: only the document's own words repeat);
    component_id is the least id reachable over partners.
    """
    texts, names = named_texts(docs)
    seeds = materialize(texts.mapInArrow(seed_rows(GRAM, LEAST - GRAM + 1, LEAST, False, True), "h long, d long, pos int, before int, number int"), "suffix-seeds")
    often = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = materialize(seeds.join(often.hint("merge"), "h"), "suffix-often")
    discard(seeds)
    places = materialize(kept.groupBy("d").agg(F.collect_list(F.struct("pos", "h")).alias("at")), "suffix-kept")
    rows = texts.join(places.hint("merge"), "d").select("d", "text", "at").mapInArrow(_contexts, _ROW)
    rows = materialize(rows, "suffixes")
    discard(places)
    found = over_neighbours(rows, ["h", "right", "left", "d", "pos"], NEIGHBOURS, compare, "d long, start int, end int, other long", "suffix-matches")
    frequent = kept.where(F.col("n") > NEIGHBOURS + 1).select("h", "d", "pos", "before", "number")
    passages = materialize(found.unionByName(frequent_windows(rows, frequent)).distinct(), "suffix-passages")
    discard(kept)
    discard(rows)
    return by_document(passages, names)


def by_document(passages: DataFrame, names: DataFrame | None) -> DataFrame:
    """(d, start, end, other) -> one row a document: its ranges joined, each with the least partner, and its class.

    A document has no more ranges than words, however many others share them.
    names: the ids of d, where they differ.
    """
    edges = passages.select(F.col("d").alias("u"), F.col("other").alias("v"))
    if names is not None:
        passages = passages.join(names.select(F.col("d").alias("other"), F.col("doc_id").alias("partner")), "other", "left").select("d", "start", "end", F.col("partner").alias("other"))
    else:
        passages = passages.withColumn("other", F.when(F.col("other") != F.col("d"), F.col("other")))
    ranges = passages.groupBy("d", "start").agg(F.max("end").alias("end"), F.min("other").alias("other"))
    joined = ranges.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("start", "end", "other"))).alias("r"))

    def grow(out, x):
        last = F.try_element_at(out, F.lit(-1))
        union = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.least(last["other"], x["other"]).alias("other"))
        kept = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when((F.size(out) > 0) & (x["start"] <= last["end"]), F.concat(kept, F.array(union))).otherwise(F.concat(out, F.array(x)))

    joined = joined.select("d", F.aggregate("r", F.slice("r", 1, 0), grow).alias("spans"))
    comps = connected_components(edges)
    out = joined.join(comps.withColumnRenamed("node", "d"), "d", "left").withColumn("component", F.coalesce("component", "d"))
    if names is None:
        out = out.select(F.col("d").alias("doc_id"), "spans", F.col("component").alias("component_id"))
    else:
        out = out.join(names, "d")
        least = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        out = out.join(least, "component").select("doc_id", "spans", "component_id")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return out.select("doc_id", covered.alias("covered"), "spans", "component_id")


def op2_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
