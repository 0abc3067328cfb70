"""Embedding near-duplicates by a forest of random-projection trees.

``TREES`` trees are fitted on a sample of at most ``SAMPLE`` vectors: a node
projects its vectors on a random direction and splits at the median; vectors
within ``SPILL`` of the median (in shares of the node) go to both sides. A node
stops at a share of the sample that stands for about ``LEAF`` rows of the table,
or when its vectors are so close to one another that a split would part links.
Every vector of the table is routed to all its leaves in all trees, whole
leaves are compared in double precision, and links are united.

A leaf of more than ``MOST`` times ``LEAF`` rows is split further by a small tree of its own, fitted on a
bounded sample of its rows in a task; this is repeated, without the driver, until
leaves are small or no split leaves links whole, so leaves don't grow with the table.

Equal vectors are one node with a count. A leaf of more than ``BLOCK`` vectors is
cut into blocks and each two blocks are one task, so no leaf is too large, and
nothing is left out. Tasks return, per vector, how many vectors it links to, and
a spanning forest of the links; a pair that meets in several leaves counts only
in the first of them, which both rows' lists of leaves tell.

Edge cases: a null or empty vector, one with null, infinite or NaN components
and the zero vector link with nothing. Vectors of different lengths don't link.
Rows with a null id link with nothing and stay. Repeated rows are equal vectors. Vectors are scaled by their
largest component before their length is taken, so magnitudes don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

TREES, SAMPLE, LEAF, BLOCK, SPILL, TIGHT, SEED = 12, 16384, 512, 512, 0.05, 0.9, 5
#: Leaves of more than so many times LEAF rows are split again, by trees of so many levels fitted on so many rows.
MOST, LEVELS, LEAF_SAMPLE = 4, 4, 1024


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their magnitudes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_forest(sample: np.ndarray, total: int, trees: int = TREES, seed: int = SEED, leaf_rows: int = LEAF, levels: int = 40) -> list[dict]:
    """Trees as arrays: direction of each node, the two bounds, its children; a child below 0 is leaf -child."""
    unit = unit_rows(sample)
    least = max(8.0, leaf_rows * len(unit) / max(total, 1))
    out, leaf = [], 0
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        dirs, bounds, kids = [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            nonlocal leaf
            x = unit[rows]
            if len(rows) <= least or depth >= levels or np.linalg.norm(x.mean(axis=0)) >= TIGHT:
                leaf += 1
                return -leaf
            d = rng.standard_normal(unit.shape[1])
            z = x @ (d / np.linalg.norm(d))
            low, high = np.quantile(z, [0.5 - SPILL, 0.5 + SPILL])
            if (z <= high).all() or (z >= low).all():
                leaf += 1
                return -leaf
            node = len(dirs)
            dirs.append(d / np.linalg.norm(d))
            bounds.append((low, high))
            kids.append([0, 0])
            kids[node] = [grow(rows[z <= high], depth + 1), grow(rows[z >= low], depth + 1)]
            return node

        root = grow(np.arange(len(unit)), 0)
        out.append({"root": root, "dirs": np.array(dirs).reshape(len(dirs), unit.shape[1]), "bounds": np.array(bounds).reshape(len(bounds), 2), "kids": np.array(kids, np.int64).reshape(len(kids), 2)})
    return out


def leaves_of(forest: list[dict], x: np.ndarray) -> list[list[int]]:
    """All leaves of each row of x, sorted."""
    found: list[list[int]] = [[] for _ in range(len(x))]
    unit = unit_rows(x)
    for tree in forest:
        todo = [(tree["root"], np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                for r in rows:
                    found[r].append(-node)
                continue
            z = unit[rows] @ tree["dirs"][node]
            low, high = tree["bounds"][node]
            todo.append((int(tree["kids"][node][0]), rows[z <= high]))
            todo.append((int(tree["kids"][node][1]), rows[z >= low]))
    return [sorted(set(f)) for f in found]


def _compare(cosine: float):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values(["own", "id"])
        leaf, ids, own = int(pdf["leaf"].iloc[0]), pdf["id"].to_numpy(), pdf["own"].to_numpy()
        x = unit_rows(np.array(pdf["v"].tolist(), np.float64))
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if pdf["two"].iloc[0]:
            linked &= own[:, None] != own[None, :]
        earlier: dict[int, int] = {}
        cells = [(r, earlier.setdefault(f, len(earlier))) for r, fs in enumerate(pdf["leaves"]) for f in fs if f < leaf]
        if cells and linked.any():
            at = np.zeros((len(ids), len(earlier)), np.float32)
            r, c = np.array(cells).T
            at[r, c] = 1
            linked &= (at @ at.T) == 0
        counts = linked @ pdf["copies"].to_numpy().astype(np.float64)
        root, seen = np.arange(len(ids)), np.zeros(len(ids), bool)
        for s in np.flatnonzero(linked.any(axis=1)):
            if not seen[s]:
                seen[s] = True
                stack = [s]
                while stack:
                    y = np.flatnonzero(linked[stack.pop()] & ~seen)
                    seen[y] = True
                    root[y] = s
                    stack += y.tolist()
        some = np.flatnonzero(counts)
        return pd.DataFrame({"id": ids[some], "n": counts[some].astype(np.int64), "to": ids[root[some]]})

    return run


def _fit_leaf(leaf_rows: int):
    import pandas as pd

    def run(pdf):
        """The tree of one leaf from a sample of its rows; null where no split leaves its links whole."""
        leaf, total = int(pdf["leaf"].iloc[0]), int(pdf["n"].iloc[0])
        x = np.array(pdf.sort_values("id")["v"].tolist(), np.float64)
        tree = fit_forest(x, total, 1, leaf % (1 << 31), leaf_rows, LEVELS)[0]
        model = pickle.dumps(tree) if tree["root"] >= 0 else None
        return pd.DataFrame({"leaf": [leaf], "model": [model]})

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, leaf, v, model) -> (id, leaf, parts): the leaves that take the place of leaf."""
    for batch in batches:
        leaf, models, vectors = batch.column(1).to_numpy(), batch.column(3), batch.column(2)
        parts: list = [None] * batch.num_rows
        for one in np.unique(leaf).tolist():
            at = np.flatnonzero(leaf == one)
            x = np.array(vectors.take(pa.array(at)).to_pylist(), np.float64)
            for r, found in zip(at.tolist(), leaves_of([pickle.loads(models[int(at[0])].as_py())], x), strict=True):
                parts[r] = [int.from_bytes(blake2b(f"{one}/{f}".encode(), digest_size=7).digest()) for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int64()))], ["id", "leaf", "parts"])


def _small_leaves(routed: DataFrame, leaf_rows: int) -> DataFrame:
    """routed (id, v, copies, leaves) with too large leaves split, again and again."""
    whole = None
    while True:
        sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST * leaf_rows)
        if whole is not None:
            sizes = sizes.join(whole, "leaf", "left_anti")
        sizes = materialize(sizes, "large-leaves")
        if sizes.isEmpty():
            return routed
        members = routed.select("id", "v", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
        sample = members.where(F.pmod(F.xxhash64("id", "leaf"), F.col("n")) < LEAF_SAMPLE)
        models = materialize(sample.groupBy("leaf").applyInPandas(_fit_leaf(leaf_rows), "leaf long, model binary"), "leaf-trees")
        new = models.where("model is null").select("leaf")
        whole = new if whole is None else whole.unionByName(new)
        parts = members.join(models.where("model is not null"), "leaf").select("id", "leaf", "v", "model").mapInArrow(_split, "id long, leaf long, parts array<long>")
        parts = parts.groupBy(F.col("id").alias("_id")).agg(F.collect_set("leaf").alias("_old"), F.flatten(F.collect_list("parts")).alias("_new"))
        leaves = F.array_sort(F.array_distinct(F.concat(F.array_except("leaves", "_old"), F.col("_new"))))
        joined = routed.join(parts, F.col("id") == F.col("_id"), "left")
        routed = materialize(joined.select("id", "v", "copies", F.when(F.col("_id").isNull(), F.col("leaves")).otherwise(leaves).alias("leaves")), "vector-leaves")


def near_vectors(rows: DataFrame, cosine: float = 0.95, trees: int = TREES, leaf_rows: int = LEAF) -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, n_links, component_id, kept, one row per row."""
    spark = rows.sparkSession
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0).cast(kind[6:-1]))).alias("v"))
    named = named.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.hash("v")))
    named = materialize(named, "vectors")
    same = ["h1", "h2"]
    nodes = named.where("v is not null").groupBy(*same).agg(F.min(F.struct("vec_id", "v")).alias("m"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.select(*same, F.col("m.vec_id").alias("id"), F.col("m.v").alias("v"), "copies"), "vector-nodes")

    lengths = [(r[0], r[1]) for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "d").collect()]
    parts = []
    for number, (d, total) in enumerate(lengths):
        own = nodes.where(F.size("v") == d)
        sample = np.array([r[0] for r in own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], np.float64)
        forest, base = fit_forest(sample, total, trees, SEED, leaf_rows), number << 40

        def route(batches: Iterator[pa.RecordBatch], forest=forest, base=base) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                    found = [[base + y for y in f] for f in leaves_of(forest, x)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], ["id", "v", "copies", "leaves"])

        parts.append(own.select("id", "v", "copies").mapInArrow(route, f"id long, v {kind}, copies long, leaves array<long>"))
    if not parts:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    routed = parts[0]
    for p in parts[1:]:
        routed = routed.unionByName(p)
    routed = _small_leaves(materialize(routed, "vector-leaves"), leaf_rows)
    placed = routed.select("*", F.explode("leaves").alias("leaf"))
    sizes = materialize(routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "leaf-sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    tiles = placed.join(sizes, "leaf").select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "leaf"), blocks).cast("int").alias("own"))
    tiles = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", (F.col("own") != F.col("other")).alias("two"), "id", "v", "copies", "leaves")
    found = materialize(tiles.groupBy("leaf", "i", "j").applyInPandas(_compare(cosine), "id long, n long, to long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("id").alias("u"), F.col("to").alias("v")))
    known = nodes.select(*same, "id", "copies").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = named.join(known, same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""with recursive v as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
  reach as (select vec_id as node, vec_id as seen from embeddings union select r.node, k.v from reach r join links k on k.u = r.seen),
  c as (select node, min(seen) as component_id from reach group by 1), n as (select u, count(*) as n from links group by 1)
  select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join c on node = vec_id left join n on u = vec_id"""
