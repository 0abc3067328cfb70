"""MinHash near-duplicates by a multi-index Hamming join.

Every text's distinct word shingles give 40 b-bit MinHash values (16 bits
each). The signature is split into 8 chunks of 5 values; by pigeonhole, two
signatures that differ in at most 15 values differ in at most one value of
some chunk, so indexing each chunk with each one of its values left out (40
keys a text) meets *every* such pair, and most pairs beyond: at Jaccard 0.85 a
pair meets on no key with probability 6e-7, at 0.8 with 2e-5. Pairs that meet and
differ in at most ``DISTANCE`` values (a pair at 0.85 differs in more with
probability 1e-11, at 0.8 with 6e-9) are confirmed on their full shingle sets.

Texts with equal shingle sets are one node. Buckets of up to ``SMALL`` texts
give their pairs. In a larger one every text first meets one representative,
the same for all buckets that share it, so a cluster of n copies costs about n pairs
however many keys it shares. Texts that are linked then needn't meet each other.
Those outside the representative's component are compared with all texts of
its buckets, taken together, in blocks: a task compares two blocks on their full
sets and returns a spanning forest of the links it finds between different
components, so no pair is dropped and none is written out.

Edge cases: a null, empty or blank text has an empty set, links with nothing
and is kept. A null id links with nothing, its component is null, kept is
true. Rows repeated with the same id and text share one result each; different
texts of one id are compared as documents of their own, and a component is named
by its least id. Ties go by id. An empty table gives an empty result. Texts of
any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import connected_components, discard, materialize, table

CHUNKS, PER_CHUNK = 8, 5
LANES = CHUNKS * PER_CHUNK
#: Values in which the signatures of a pair may differ. All pairs up to 2 * CHUNKS - 1 meet by pigeonhole, those beyond by chance.
DISTANCE = 24
SMALL, BLOCK = 48, 512

_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64)
_S = [f"s{i}" for i in range((LANES + 3) // 4)]


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for i, j, keys, offs in W.text_shingles(batch.column(2), k):
                n = np.diff(offs)
                some = np.flatnonzero(n)
                at = offs[:-1][some]
                v = W.mix((keys & np.uint64((1 << 52) - 1)) + np.uint64(1))
                lanes = np.zeros((j - i, len(_S) * 4), np.uint64)
                sums = np.zeros((2, j - i), np.uint64)
                if len(some):
                    h = np.empty_like(v)
                    for lane in range(LANES):
                        np.multiply(v, _MUL[lane], out=h)
                        h += _ADD[lane]
                        lanes[some, lane] = W.mix(np.minimum.reduceat(h, at)) >> np.uint64(48)
                    sums[0, some] = np.add.reduceat(v, at)
                    sums[1, some] = np.add.reduceat(W.mix(v), at)
                packed = lanes.reshape(j - i, len(_S), 4)
                packed = packed[:, :, 0] | packed[:, :, 1] << np.uint64(16) | packed[:, :, 2] << np.uint64(32) | packed[:, :, 3] << np.uint64(48)
                cols = [ids.slice(i, j - i), marks.slice(i, j - i), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums)]
                cols += [pa.array(np.ascontiguousarray(packed[:, c]).view(np.int64)) for c in range(len(_S))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "n_shingles", "f1", "f2", *_S])

    return run


def _lane(i: int):
    return F.shiftrightunsigned(F.col(_S[i // 4]), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def index_keys():
    """The keys of a signature: each chunk with each one of its values left out."""
    return F.array(
        *(
            F.xxhash64(F.lit(c * PER_CHUNK + out), *(_lane(c * PER_CHUNK + x) for x in range(PER_CHUNK) if x != out))
            for c in range(CHUNKS)
            for out in range(PER_CHUNK)
        )
    )


def _differing(a: str, b: str):
    """In how many 16-bit values two signatures differ."""
    total = F.lit(0)
    for s in _S:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total + F.bit_count(x)
    return total


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << 52) - 1)
        for batch in batches:
            u, v = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in (0, 1))
            left, right = batch.column(2), batch.column(3)
            for at in range(0, batch.num_rows, 512):
                n = min(512, batch.num_rows - at)
                sets = []
                for side in (left, right):
                    keys = [(ks & low) | ((ks >> np.uint64(52)) + np.uint64(i)) << np.uint64(52) for i, _, ks, _ in W.text_shingles(side.slice(at, n), k)]
                    sets.append(np.concatenate(keys))
                sizes = sum(np.bincount((s >> np.uint64(52)).astype(np.int64), minlength=n) for s in sets)
                both = np.concatenate(sets)
                both.sort()
                same = both[1:][both[1:] == both[:-1]]
                common = np.bincount((same >> np.uint64(52)).astype(np.int64), minlength=n)
                ok = 100 * common >= percent * (sizes - common)
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + n][ok]), pa.array(v[at : at + n][ok])], ["u", "v"])

    return run


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the shingle sets are near enough to one another."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[code] > 1
    alive, code = np.unique(code[keep], return_inverse=True)
    owner = owner[keep]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(alive), 4096):
        part = (code >= lo) & (code < lo + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[part], code[part] - lo] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def _tile(k: int, percent: int):
    import pandas as pd

    def run(pdf):
        """A forest of the links of one tile between different components, one end outside the main one."""
        pdf = pdf.drop_duplicates("id").sort_values(["own", "id"])
        ids, comp, own, outer = (pdf[c].to_numpy() for c in ("id", "comp", "own", "outer"))
        sets = []
        for _, _, keys, offs in W.text_shingles(pa.array(pdf["text"], pa.large_string()), k):
            keys = keys & np.uint64((1 << 52) - 1)
            sets += [keys[offs[x] : offs[x + 1]] for x in range(len(offs) - 1)]
        linked = _linked(sets, percent) & (comp[:, None] != comp[None, :]) & (outer[:, None] | outer[None, :])
        if pdf["two"].iloc[0]:
            linked &= own[:, None] != own[None, :]
        seen, links = np.zeros(len(ids), bool), []
        for root in np.flatnonzero(linked.any(axis=1)).tolist():
            stack = [] if seen[root] else [root]
            seen[root] = True
            while stack:
                x = stack.pop()
                for y in np.flatnonzero(linked[x] & ~seen).tolist():
                    seen[y] = True
                    links.append((ids[x], ids[y]))
                    stack.append(y)
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return run


def _tiles(many: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (tile, id, comp, outer, own, two) of the tiles in which the texts outside the main component of their
    buckets meet all others there; buckets with one main component are taken together."""
    main = reps.select("key", F.col("rep.id").alias("rep")).join(comps, F.col("rep") == comps.node, "left").select("key", F.coalesce("component", "rep").alias("main"))
    rows = many.select("key", "id").join(main, "key").select("main", "id").distinct()
    rows = rows.join(comps, rows.id == comps.node, "left").select("main", "id", F.coalesce("component", "id").alias("comp"))
    rows = rows.withColumn("outer", F.col("comp") != F.col("main"))
    sizes = rows.groupBy("main").agg(F.sum(F.col("outer").cast("long")).alias("n_out"), F.count(F.lit(1)).alias("n_all")).where("n_out > 0")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    rows = rows.join(sizes, "main").select("main", "id", "comp", "outer", blocks(F.col("n_out")).alias("outs"), blocks(F.col("n_all") - F.col("n_out")).alias("ins"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("outer"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    one = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    among = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda o: one(0, F.least("own", o), F.greatest("own", o)))
    with_in = F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda o: one(1, F.col("own"), o))
    from_in = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda o: one(1, o, F.col("own")))
    rows = rows.select("main", "id", "comp", "outer", "own", F.explode(F.when(F.col("outer"), F.concat(among, with_in)).otherwise(from_in)).alias("t"))
    # In a tile of outer and inner texts these are its sides; in a tile of outer blocks, the blocks are.
    side = F.when(F.col("t.kind") == 1, F.col("outer").cast("int")).otherwise(F.col("own"))
    two = (F.col("t.kind") == 1) | (F.col("t.i") != F.col("t.j"))
    return rows.select(F.xxhash64("main", "t.kind", "t.i", "t.j").alias("tile"), "id", "comp", "outer", side.alias("own"), two.alias("two"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Link texts whose k-word shingle sets have 100 * |A & B| >= percent * |A | B|.

    Returns doc_id, n_shingles, component_id, kept: the result described in the
    module's text; and t, the text's hash, and node, the group's name, which differs even where two groups have one least id. percent should be 80 or more: the index is made for that.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    schema = "doc_id long, t long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{s} long" for s in _S)
    sigs = materialize(texts.select("doc_id", "t", "text").mapInArrow(W.tidy(_signatures(k)), schema), "minhash")
    same = ["f1", "f2", "n_shingles"]
    # A node is a shingle set, named by a hash; its text is that of its least id.
    reps = sigs.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "t")).alias("m"), *(F.first(s).alias(s) for s in _S))
    reps = materialize(reps.select(*same, F.xxhash64(*same).alias("id"), F.col("m.doc_id").alias("least"), F.col("m.t").alias("t"), *_S), "minhash-sets")

    keyed = reps.select("id", *_S, F.explode(index_keys()).alias("key"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keyed.join(often.hint("merge"), "key").select("key", "n", "id", *_S), "minhash-buckets")

    # Buckets of bounded size: their pairs, once each. Larger ones: each text with one representative, the same in all its buckets.
    pair = [F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")]
    few = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("id", *_S)).alias("m"))
    pairs = few.select(F.col("m"), F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("b"))
    many = members.where(F.col("n") > SMALL)
    reps_of = materialize(many.groupBy("key").agg(F.min(F.struct(F.hash("id").alias("order"), "id", *_S)).alias("rep")), "minhash-representatives")
    stars = many.join(reps_of, "key").where(F.col("id") != F.col("rep.id")).select(F.struct("id", *_S).alias("a"), F.col("rep").alias("b"))
    near = _differing("a", "b") <= DISTANCE
    pairs = materialize(pairs.where(near).select(*pair).unionByName(stars.where(near).select(*pair)).distinct(), "minhash-pairs")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = reps.select("id", "least", "t").join(ids.distinct().hint("merge"), "id", "left_semi")
        found = texts.join(wanted.select(F.col("least").alias("doc_id"), "t", "id").hint("merge"), ["doc_id", "t"]).groupBy("id").agg(F.min("text").alias("text"))
        return materialize(found, "minhash-texts")

    some = texts_of(pairs.select(F.explode(F.array("u", "v")).alias("id")))
    one, two = (some.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "uv")
    links = materialize(pairs.join(two, "v").join(one, "u").select("u", "v", "tu", "tv").mapInArrow(W.tidy(_confirm(k, percent)), "u long, v long"), "minhash-links")
    discard(some)
    comps = connected_components(links)
    if not reps_of.isEmpty():
        tiles = materialize(_tiles(many, reps_of, comps), "minhash-tiles")
        inner = texts_of(tiles.select("id"))
        more = materialize(tiles.join(inner, "id").select("tile", "id", "comp", "outer", "own", "two", "text").groupBy("tile").applyInPandas(_tile(k, percent), "u long, v long"), "minhash-links")
        discard(inner)
        comps = connected_components(links.unionByName(more))
    discard(members)

    classes = reps.join(comps, reps.id == comps.node, "left").select(*same, "least", F.coalesce("component", "id").alias("node"))
    named = classes.groupBy("node").agg(F.min("least").alias("c"))
    classes = classes.join(named, "node").select(*same, "c", "node")
    out = sigs.select("doc_id", "t", *same).join(classes, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "t", "node").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as s from w),
  e as (select doc_id, len(s) as n, unnest(s) as g from s),
  p as (select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as m from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
  l as (select u, v from p where 100 * m >= 85 * (nu + nv - m)), links as (select u, v from l union all select v, u from l),
  reach as (select doc_id as node, doc_id as seen from s union select r.node, k.v from reach r join links k on k.u = r.seen)
  select s.doc_id, len(s.s)::bigint as n_shingles, min(seen) as component_id, s.doc_id = min(seen) as kept from s join reach on node = s.doc_id group by s.doc_id, s.s"""
