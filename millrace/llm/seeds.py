"""Content-selected positions (minimisers of word k-grams, of all texts of a slice at once), and scans over the neighbours of a cluster-wide sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize


def minimisers(h: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word positions (in the slice) of the least k-gram of each window of w k-grams, these grams' hashes, and the
    first and the number of the windows that each is the least of (0: none of w k-grams).

    Windows stay within a text; a text of k or more words but fewer than w
    k-grams is one window. Two texts that share w + k - 1 words in a row share a
    selected position there.
    """
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = W.grams(h, k)
    n_grams = np.maximum(np.diff(first) - k + 1, 0)
    chosen, begin, count = [], [], []
    if len(g) >= w:
        # Least gram of each window and its place, by doubling: the first of equal ones.
        least, place, size = g, np.arange(len(g)), 1
        while size < w:
            step = min(size, w - size)
            left = least[: len(least) - step] <= least[step:]
            place = np.where(left, place[: len(place) - step], place[step:])
            least = np.where(left, least[: len(least) - step], least[step:])
            size += step
        ok = np.zeros(len(least) + 1, np.int64)
        long = n_grams >= w
        np.add.at(ok, first[:-1][long], 1)
        np.add.at(ok, (first[:-1] + n_grams - w + 1)[long], -1)
        windows = np.flatnonzero(np.cumsum(ok)[:-1] > 0)
        at, lead, number = np.unique(place[windows], return_index=True, return_counts=True)
        chosen, begin, count = [at], [windows[lead]], [number]
    for d in np.flatnonzero((n_grams > 0) & (n_grams < w)):
        at = np.array([first[d] + int(np.argmin(g[first[d] : first[d] + n_grams[d]]))])
        chosen, begin, count = [*chosen, at], [*begin, at], [*count, np.zeros(1, np.int64)]
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, begin, count = (np.concatenate(x) for x in (chosen, begin, count))
    order = np.argsort(at, kind="stable")
    return at[order], g[at[order]], begin[order], count[order]


def seed_rows(k: int, w: int, least_words: int, fold: bool, windows: bool = False):
    """mapInArrow function: (d, text) -> (h, d, pos) of the minimisers of texts with enough words.

    With windows also before, number: how many words before pos the first window begins that it is the least of, and how many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            for i, _, b, o in W.slices(batch.column(1)):
                start, end, first = W.spans(b, o)
                at, g, begin, count = minimisers(W.hashes(b, start, end, fold), first, k, w)
                doc = np.searchsorted(first, at, "right") - 1
                keep = np.diff(first)[doc] >= least_words
                at, g, doc, begin, count = (x[keep] for x in (at, g, doc, begin, count))
                cols = [pa.array(g.view(np.int64)), pa.array(ids[i + doc].astype(np.int64)), pa.array((at - first[doc]).astype(np.int32))]
                names = ["h", "d", "pos"]
                if windows:
                    cols += [pa.array((at - begin).astype(np.int32)), pa.array(count.astype(np.int32))]
                    names += ["before", "number"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def over_neighbours(rows: DataFrame, order: list[str], near: int, compare: Callable[[pa.Table], pa.RecordBatch], schema: str, label: str) -> DataFrame:
    """What compare finds in all rows and their near next ones, in the order of the given columns over the cluster.

    compare takes a table of rows in order and returns rows of schema. Tasks keep
    the last rows over their batches. The first and last rows of every task are
    returned too and compared once more by themselves, in one small task of at most 2 * near rows a task.
    """
    from pyspark.sql.types import StructType

    names, kinds = rows.columns, StructType.fromDDL(schema)
    edge = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema.fields) + ">"

    def scan(borders: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = head = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                now = pa.Table.from_batches([batch])
                if head is None or head.num_rows < near:
                    head = (now if head is None else pa.concat_tables([head, now])).slice(0, near)
                both = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
                found = compare(both)
                if borders:
                    kind = pa.struct([pa.field(f.name, f.type) for f in both.schema])
                    found = pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, kind)], [*kinds.names, "edge"])
                yield found
                held = both.slice(max(0, both.num_rows - near))
            if borders and head is not None:
                rest = pa.concat_tables([head, held]).combine_chunks()
                cols = [c.combine_chunks() for c in rest.columns]
                edges = pa.StructArray.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names)
                nothing = compare(rest.slice(0, 0))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(edges), c.type) for c in nothing.columns), edges], [*kinds.names, "edge"])

        return run

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    found = materialize(dealt.mapInArrow(scan(True), f"{schema}, edge {edge}"), label)
    edges = found.where("edge is not null").select("edge.*").distinct().repartition(1).sortWithinPartitions(*order).select(*names)
    return found.where("edge is null").select(*kinds.names).unionByName(edges.mapInArrow(scan(False), schema))
