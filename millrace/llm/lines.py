"""Line near-duplicates by a segment-partition edit join, in SQL functions only.

Equal lines of any length are one. Lines of ``LIMITS`` characters or more also
match with 1 or 2 edits (the shorter line's length decides): a line is cut into
one segment more than its edits. By pigeonhole, of two lines within that many
edits one has a segment that the other holds unchanged, at a place that its
length and the segment's number bound. The segments are the index; each line probes it with the few substrings
that the multi-match-aware rule allows for its own and each smaller length.
Keys are counted first; lines that share one are read again. Those that meet, and
whose counts of letters and digits could belong to lines so near, are verified by a
banded bit-parallel edit distance: the
vertical differences of 2 * ``EDITS`` + 1 diagonals are the bits of two
integers that one pass over the characters updates.

Equal lines are one node before the join, so a line with any number of copies
takes part once. Segments are joined one number after the other, which bounds
the rows on disk; a segment that very many lines share is split over tasks by
adaptive execution, and its lines meet within the join, where counts that are
too far apart drop them: no pair of theirs is written out. Of each group of
lines linked so (through others as well), the first by doc_id and position
stays and the rest are dropped from their texts.

Edge cases: blank lines always stay. Null text counts
as empty and stays null. Rows with a null doc_id keep their text and take no
part. Rows repeated with the same id and text hold the same lines; their
first copies stay in each. Different texts of one id are told apart by their
hash, and each keeps or loses its own lines. Ties go by id, line and text hash.
An empty table gives an empty one; other columns stay as they are. Lines and
texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, table

EDITS, SHORTEST = 2, 1
#: From so many characters on, a line may differ from its like by 1 and by 2 edits; shorter ones must be equal.
LIMITS = {1: 10, 2: 20}
#: Characters whose counts, modulo 8, make a line's sketch, the common ones first; one edit changes two counts by one at most.
LETTERS = " etaonihrsdulgcmfwypbvkxjqz"
#: The same for the digits, in which the lines of one template differ.
DIGITS = "0123456789"
SKETCH = ["s1", "s2", "s3"]


def _places(edits: int, less: int) -> list[tuple[int, int]]:
    """(segment, shift) that a line probes for lines shorter by less, by both bounds on the shift."""
    bounds = [(i, max(-i, less - (edits - i)), min(i, less + (edits - i))) for i in range(edits + 1)]
    return [(i, shift) for i, low, high in bounds for shift in range(low, high + 1)]


def with_segments(lines: DataFrame) -> DataFrame:
    """lines (line, n) with what its segments hang on, for lines shorter by 0 to EDITS characters: their length, the
    shorter segments' size, and how many are of that size; and the line's characters in four bytes each."""
    for less in range(EDITS + 1):
        parts = f"if(n - {less} >= {LIMITS[EDITS]}, {EDITS + 1}, 2)"
        lines = lines.withColumn(f"l{less}", F.expr(f"n - {less}")).withColumn(f"q{less}", F.expr(f"(n - {less}) div {parts}")).withColumn(f"r{less}", F.expr(f"cast({parts} - pmod(n - {less}, {parts}) as int)"))
    return lines.withColumn("wide", F.encode("line", "UTF-32"))


def probe_keys() -> list[tuple[str, int, int, bool, bool]]:
    """(SQL, segment, least length of the line, for lines of its length, its own segment) of the hashes of substrings of
    a line that may equal a segment of a line shorter by 0 to EDITS characters. All code is plain and short: the
    Java compiler leaves long methods uncompiled."""
    out = []
    for less in range(EDITS + 1):
        fewer, most = _places(1, less) if less <= 1 else [], _places(EDITS, less)
        if not set(fewer) <= set(most):
            raise ValueError("the places of a smaller limit must be among those of the larger")
        begin = lambda i: f"({i} * q{less} + greatest(0, {i} - r{less}))"  # noqa: B023, E731
        for i, shift in most:
            hashed = f"xxhash64(l{less}, {i}, substring(wide, cast(4 * ({begin(i)} + {shift}) + 1 as int), cast(4 * ({begin(i + 1)} - {begin(i)}) as int)))"
            out.append((hashed, i, less + LIMITS[1 if (i, shift) in fewer else EDITS], not less, not less and not shift))
    return out


def _counted(text, chars: str):
    """(low, high, rest): counts of chars in text, modulo 8, four bits each, in two numbers, and text without them.

    A count's four bits are its place on a ring of eight codes whose neighbours differ in one bit.

    Each character is taken out of what those before it have left, so the text gets
    shorter with every step. A step notes what the step before it took out.
    """
    ring = lambda n: F.call_function("shiftright", F.lit(0x8CEF7310), n.bitwiseAND(F.lit(7)) * 4).bitwiseAND(F.lit(15))
    taken = lambda state: ring(state["before"] - F.octet_length(state["rest"]))
    low = lambda state: F.shiftleft(state["low"], 4).bitwiseOR(taken(state))
    high = lambda state: F.shiftleft(state["high"], 4).bitwiseOR(F.shiftrightunsigned(state["low"], 60))
    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), text.alias("rest"), F.octet_length(text).alias("before"))
    step = lambda state, c: F.struct(low(state).alias("low"), high(state).alias("high"), F.replace(state["rest"], c, F.lit("")).alias("rest"), F.octet_length(state["rest"]).alias("before"))
    last = lambda state: F.struct(low(state).alias("low"), high(state).alias("high"), state["rest"].alias("rest"))
    return F.aggregate(F.array(*(F.lit(c) for c in chars)), start, step, last)


def with_sketches(lines: DataFrame) -> DataFrame:
    """lines (line) with s1, s2 (counts of LETTERS) and s3 (counts of DIGITS, which hardly any line has)."""
    lines = lines.withColumn("_l", _counted(F.col("line"), LETTERS))
    digits = F.when(F.col("_l.rest").rlike("[0-9]"), _counted(F.col("_l.rest"), DIGITS)["low"]).otherwise(F.lit(0).cast("long"))
    return lines.select("*", F.col("_l.low").alias("s1"), F.col("_l.high").alias("s2"), digits.alias("s3")).drop("_l")


def _sketches_apart(pairs: list[tuple]):
    """A lower bound of twice the edit distance of two lines, from their sketches: the bits in which they differ."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in pairs), F.lit(0))


def _let(value, body):
    """body(value) with value computed once: a one-element array is mapped."""
    return F.get(F.transform(F.array(value), body), 0)


def banded_distance(a: str, b: str, k: int = EDITS):
    """Edit distance of two strings of lengths that differ by k at most, right if it is k or less (else more than k).

    Bit i of vp and vn says whether the distance rises or falls from row j - k + i - 1
    to the next in column j; match has the same rows' equal characters.
    """
    full = (1 << (2 * k + 1)) - 1

    def column(chars, j):
        hit = F.lit(0)
        for bit in range(2 * k + 1):
            hit = hit + F.when(F.get(chars["p"], j - k + bit - 1) == F.get(chars["t"], j - 1), F.lit(1 << bit)).otherwise(F.lit(0))
        return hit

    def diagonal(state, match):
        vp = state["vp"]
        return ((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(state["vn"]).bitwiseAND(F.lit(full))

    def settle(state, d0, j, rows):
        hp = state["vn"].bitwiseOR(F.lit(full).bitwiseAND(F.bitwise_not(d0.bitwiseOR(state["vp"]))))
        hn = d0.bitwiseAND(state["vp"])
        down = F.shiftright(d0, 1)
        vp = hn.bitwiseOR(F.lit(full).bitwiseAND(F.bitwise_not(down.bitwiseOR(hp))))
        last = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), rows - j + F.lit(k)))
        along = F.when(hp.bitwiseAND(last) != 0, 1).when(hn.bitwiseAND(last) != 0, -1).otherwise(0)
        more = F.when(j <= rows - F.lit(k), F.when(d0.bitwiseAND(F.lit(1 << (2 * k))) != 0, 0).otherwise(1)).otherwise(along)
        return F.struct(vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["d"] + more).alias("d"))

    def distance(chars):
        start = F.struct(F.lit(full ^ ((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
        step = lambda state, j: _let(column(chars, j), lambda match: _let(diagonal(state, match), lambda d0: settle(state, d0, j, F.size(chars["p"]))))
        # The last columns lower the distance by 2 * k at most, so beyond 3 * k + 1 the pair is lost and steps are skipped.
        guarded = lambda state, j: F.when(state["d"] > 3 * k + 1, state).otherwise(step(state, j))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars["t"])), start, guarded, lambda s: s["d"])

    far = F.abs(F.char_length(a) - F.char_length(b)) > k
    return F.when(far, F.lit(k + 1)).otherwise(_let(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t")), distance))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), line_no (from 0), line, n (its characters) of all lines that aren't blank."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = texts.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return every.where(F.length("line") >= SHORTEST).where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("n", F.length("line"))


def _meeting(keyed: DataFrame) -> DataFrame:
    """Hashes h of the lines that share a segment's key with another line; the keys are counted, no pair is made."""
    probes, found = probe_keys(), []
    for segment in range(EDITS + 1):
        here = [(f"p{x}", least, own) for x, (_, i, least, _, own) in enumerate(probes) if i == segment]
        probe = F.array(*(F.struct(F.col(name).alias("key"), F.lit(own).alias("own"), F.lit(least).alias("least")) for name, least, own in here))
        rows = keyed.where(F.col("n") >= min(LIMITS.values())).select("h", "n", F.explode(probe).alias("p")).where(F.col("n") >= F.col("p.least")).select("h", "p.key", "p.own")
        counted = rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own"))
        keys = materialize(counted.where("own and low < high").select("key"), "line-shared-keys")
        found.append(materialize(rows.join(keys, "key").select("h").distinct(), "lines-meeting"))
        discard(keys)
    lines = found[0]
    for more in found[1:]:
        lines = lines.unionByName(more)
    return lines.distinct()


def _near_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (u, v) of line hashes that share a segment's key and have counts near enough."""
    probes, found = probe_keys(), []
    for segment in range(EDITS + 1):
        here = [(f"p{x}", least, equal, own) for x, (_, i, least, equal, own) in enumerate(probes) if i == segment]
        (own, shortest), = [(name, least) for name, least, _, mine in here if mine]
        left = keyed.where(F.col("n") >= shortest).select("h", *SKETCH, F.col(own).alias("key"))
        probe = F.array(*(F.struct(F.col(name).alias("key"), F.lit(equal).alias("equal"), F.lit(least).alias("least")) for name, least, equal, _ in here))
        right = keyed.select(F.col("h").alias("other"), *(F.col(c).alias(f"other_{c}") for c in SKETCH), "n", F.explode(probe).alias("p")).where(F.col("n") >= F.col("p.least"))
        right = right.select("other", *(f"other_{c}" for c in SKETCH), F.col("p.key").alias("key"), F.col("p.equal").alias("equal")).hint("merge")
        # Lines of one length would meet in both directions: the probe at its own length takes only smaller partners.
        one_way = (F.col("h") < F.col("other")) | (~F.col("equal") & (F.col("h") != F.col("other")))
        counts = _sketches_apart([(F.col(c), F.col(f"other_{c}")) for c in SKETCH])
        met = left.join(right, (left["key"] == right["key"]) & one_way & (counts <= 2 * EDITS))
        found.append(materialize(met.select(F.least("h", "other").alias("u"), F.greatest("h", "other").alias("v")).distinct(), "line-pairs"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def line_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), line_no (from 0) of the lines that a group's earlier line makes needless."""
    lines = _lines(docs)
    probes = [F.expr(c).alias(f"p{x}") for x, (c, *_) in enumerate(probe_keys())]
    hashed = with_segments(lines).select("doc_id", "t", "line_no", "n", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), *probes)
    # Equal lines are one row; doc_id, line_no and t of the first tell where it is.
    values = ["n", *(f"p{x}" for x in range(len(probes)))]
    same = hashed.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no", "t")).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in values))
    keyed = materialize(same, "line-keys")
    nodes = materialize(keyed.select("h", "h2", "first", "copies"), "lines")

    # Only lines that meet another are read again, for their sketches and distances.
    places = nodes.select("h", "first.doc_id", "first.line_no", "first.t").join(_meeting(keyed).hint("merge"), "h", "left_semi")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    at = places.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "line_no")).alias("places"))
    found = texts.join(at.hint("merge"), ["doc_id", "t"]).select(F.split("text", "\n").alias("lines"), F.explode("places").alias("p"))
    found = found.select("p.h", F.get("lines", F.col("p.line_no")).alias("line")).groupBy("h").agg(F.min("line").alias("line"))
    found = materialize(with_sketches(found), "line-texts")
    pairs = materialize(_near_pairs(keyed.join(found.select("h", *SKETCH).hint("merge"), "h")), "line-pairs")
    discard(keyed)

    both = pairs.join(found.select(F.col("h").alias("u"), F.col("line").alias("a")), "u").join(found.select(F.col("h").alias("v"), F.col("line").alias("b")), "v")
    limit = F.when(F.least(F.char_length("a"), F.char_length("b")) >= LIMITS[EDITS], EDITS).otherwise(1)
    links = materialize(both.where(banded_distance("a", "b") <= limit).select("u", "v"), "line-links")
    discard(found)
    groups = materialize(connected_components(links), "line-groups")

    known = nodes.join(groups, nodes.h == groups.node, "left").select("h", "h2", "first", "copies", F.coalesce("component", "h").alias("c"))
    heads = known.groupBy("c").agg(F.min("first").alias("head"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    repeated = known.join(heads.hint("merge"), "c").select("h", "h2", "head").hint("merge")
    again = lines.select("doc_id", "t", "line_no", F.xxhash64("line").alias("h"), F.hash("line").alias("h2")).join(repeated, ["h", "h2"])
    here = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no")) & (F.col("t") == F.col("head.t"))
    return again.where(~here).select("doc_id", "t", "line_no").distinct()


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """docs with the duplicate lines taken out of text, and n_lines, n_dropped (long)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = materialize(line_duplicates(docs).groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("_gone")), "lines-gone")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "_gone")
    rows = docs.select(*own).join(gone.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_t")), "left")
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains("_gone", i))
    rows = rows.withColumn("n_lines", F.coalesce(F.size(F.when(F.col("text").isNotNull(), split)), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    rows = rows.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return rows.select(*own, "n_lines", "n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
