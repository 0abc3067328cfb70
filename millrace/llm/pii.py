"""Personal data: base patterns, candidate generators and gradient boosting, in SQL functions only.

Base spans (email, ip, card, phone) are fixed patterns with checks and always
stay. Generators of high recall propose further, overlapping spans: anything
with an at sign, addresses spelt with (at) and (dot), long runs of digits and
separators, national numbers, account numbers, and long runs of letters and digits (keys, tokens). Boosted regression trees
score each candidate from features of its format and of the text beside it;
trees are plain CASE expressions. Scores are calibrated to probabilities on
held-out examples, and per kind a threshold is chosen there that keeps the wanted
precision. A candidate at or over it that touches no base span and no better
candidate becomes a span.

The model is fitted when first used, on ``EXAMPLES`` generated, labelled texts
(a bounded sample by a fixed seed), whose features come from the very
expressions that the corpus goes through. The corpus itself is neither
collected nor shuffled: every row is handled on its own.

Positions are code points, ends exclusive. Null text counts as empty; texts of
any length are read whole; equal texts give equal spans; other columns, whatever
their names, aren't read. A null id stays null.
"""

from __future__ import annotations

import math
import random
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the method adds.
MORE = ["account", "identity", "secret"]
#: Possessive forms of the contract's patterns, which match the same spans in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators: a hint that the text must hold, and the pattern.
PROPOSE = {
    "email": ("@", r"(?:\G|(?<=[\x20\n\t<(\[,;:]))[^\x20\n\t<>()\[\],;:@]{1,64}+\x20?@\x20?[^\x20\n\t<>()\[\],;:@]{3,255}+"),
    "spelt": ("dot", r"(?i)[a-z0-9._-]{2,40}\x20?[(\[]\x20?at\x20?[)\]]\x20?[a-z0-9-]{2,40}(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?[a-z0-9-]{2,20}){1,3}"),
    "number": (None, r"\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,40}+"),
    "secret": (None, r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,200}+"),
    "account": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
CUES = {
    "call": r"(?i)(?:tel|phone|call|fax|mobile|t[eé]l[eé]phone|tel[eé]fono|telefon|anruf|sms)[^\n]{0,12}$",
    "mail": r"(?i)(?:mail|contact|write to|correo|courriel|kontakt)[^\n]{0,12}$",
    "identity": r"(?i)(?:ssn|social security|national|passport|identity|iban|account|konto|compte|cuenta|steuer)[^\n]{0,14}$",
    "plain": r"(?i)(?:version|build|chapter|section|page|isbn|order|total|year|no\.|id|hash|serial|commit|checksum|sha[0-9]*|md5|etag|uuid)[^\n]{0,8}$",
    "key": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|auth|bearer|credential|private.?key)[^\n]{0,8}$",
}
CONTEXT = 28
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 3200, 40, 3, 0.3, 0.98


def _found(pattern: str, kind: str, hint: str | None) -> Column:
    """array<struct<kind, start, end, m, left, right>> of the pattern's matches, in order."""
    text = F.col("_t")
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    one = "kind string, start int, end int, m string, left string, right string"
    none = F.array().cast(f"array<struct<{one.replace(' ', ':').replace(',:', ',')}>>")

    def add(state, i):
        start = state["at"] + F.char_length(F.get(state["g"], i))
        end = start + F.char_length(F.get(state["h"], i))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.get(state["h"], i).alias("m"), F.right(F.get(state["g"], i), F.lit(CONTEXT)).alias("left"), F.left(F.get(state["g"], i + 1), F.lit(1)).alias("right"))
        return F.struct(end.alias("at"), state["g"].alias("g"), state["h"].alias("h"), F.concat(state["out"], F.array(span)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), gaps.alias("g"), hits.alias("h"), none.alias("out"))
    walk = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), begin, add, lambda s: s["out"])
    there = F.contains(F.lower(text) if kind == "spelt" else text, F.lit(hint)) if hint else F.lit(True)
    if kind not in ("email", "spelt"):
        there = there & F.col("_digit")
    return F.when(there & text.rlike(pattern), walk).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total, i):
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = (n - i) % 2 == 1
        return total + F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, x: Column) -> Column:
    m = x["m"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    n = F.char_length(_digits(m))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.when((n >= 13) & (n <= 19), _luhn(_digits(m))).otherwise(False)


FEATURES = ["kind", "length", "digits", "letters", "seps", "plus", "paren", "dots", "dashes", "spaces", "luhn", "octets", "distinct", "chars", "upper", "hex", "tld", "before", "after", *CUES]


def _features(x: Column) -> Column:
    """array<double> of one candidate, in the order of FEATURES."""
    m, left, right = x["m"], x["left"], x["right"]
    d = _digits(m)
    count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = [
        F.element_at(F.create_map(*(F.lit(v) for i, k in enumerate(PROPOSE) for v in (k, float(i)))), x["kind"]),
        F.char_length(m).cast("double"),
        F.char_length(d).cast("double"),
        count("[A-Za-z]"),
        count(r"[\x20()./-]"),
        yes(m.startswith("+")),
        yes(m.contains("(")),
        count(r"\."),
        count("-"),
        count(r"\x20"),
        yes((F.char_length(d) >= 12) & (F.char_length(d) <= 19) & _luhn(F.left(d, F.lit(19)))),
        yes(m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        count("[A-Z]"),
        yes(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        yes(m.rlike(r"(?i)(?:\.|dot\x20?[)\]]\x20?)[a-z]{2,10}$")),
        yes(left.rlike(r"[A-Za-z0-9_#$=\"-]$")),
        yes(right.rlike(r"[A-Za-z0-9_#\"-]")),
        *(yes(left.rlike(p)) for p in CUES.values()),
    ]
    return F.array(*values)


def _name(x: Column) -> Column:
    """What a candidate is called as a span."""
    d = _digits(x["m"])
    card = (F.char_length(d) >= 13) & (F.char_length(d) <= 19) & _luhn(F.left(d, F.lit(19)))
    number = F.when(x["m"].rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "identity").when(card, "card").otherwise("phone")
    return F.when(x["kind"] == "spelt", "email").when(x["kind"] == "number", number).otherwise(x["kind"])


def candidates() -> Column:
    """All proposals of a text, with their features as f."""
    every = F.concat(*(_found(p, k, hint) for k, (hint, p) in PROPOSE.items()))
    return F.transform(every, lambda x: F.struct(x["kind"].alias("kind"), _name(x).alias("name"), x["start"].alias("start"), x["end"].alias("end"), _features(x).alias("f")))


def _with_text(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    return rows.withColumn("_digit", F.col("_t").rlike("[0-9]"))


# The model: generated examples, boosted trees, calibration.


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[int, str, int, int, int]]:
    """(id, text, start, end, label): the span to judge and whether it is personal data."""
    rng = random.Random(seed)
    words = "the of and report und der les dans para casa value house item north".split()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    run = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    name = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    local = lambda: rng.choice([name(), f"{name()}.{name()}", f"{name()}{digits(rng.randint(1, 4))}", f"{name()}.{name()}{digits(2)}", f"{name()[0]}_{name()}", f"{name()}-{digits(2)}"])
    tld = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "io"])

    def luhn(k: int, ok: bool) -> str:
        body = rng.choice("3456") + digits(k - 2)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(body)))
        return body + str((10 - total % 10 + (0 if ok else rng.randint(1, 9))) % 10)

    def private() -> tuple[str, str]:
        kind = rng.randrange(8)
        if kind == 0:
            return rng.choice(["mail ", "contact: ", "", "write to "]), f"{local()} @ {name()}.{tld()}" if rng.random() < 0.5 else f"{local()}@{name()}é.{tld()}"
        if kind == 1:
            return rng.choice(["mail ", "", "contact "]), (lambda t: t.upper() if rng.random() < 0.1 else t)(f"{local()} (at) {name()} (dot) {tld()}" if rng.random() < 0.5 else f"{local()}[at]{name()}[dot]{tld()}")
        if kind == 2:
            sep = rng.choice(["-", ".", " "])
            return rng.choice(["tel ", "phone: ", "call ", "fax "]), rng.choice([f"({digits(3)}) {digits(3)}{sep}{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"0{digits(3)}/{digits(7)}"])
        if kind == 3:
            return rng.choice(["ssn ", "social security no ", "national "]), f"{digits(3)}-{digits(2)}-{digits(4)}"
        if kind == 4:
            return rng.choice(["iban ", "account ", "konto "]), f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)} " + " ".join(digits(4) for _ in range(4)) + " " + digits(2)
        if kind >= 6:
            cue = rng.choice(["token = \"", "api_key: ", "api key ", "password=", "secret: ", "auth token: ", "Authorization: Bearer ", "access_key = ", "", ""])
            hexa, many = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
            body = rng.choice(["AKIA" + run(many[26:], 16), "ghp_" + run(many, 36), "sk-" + run(many, 40), "xoxb-" + digits(11) + "-" + run(many, 24)])
            if cue:
                body = rng.choice([body, run(hexa, rng.choice([32, 40, 64])), run(many, rng.randint(16, 44)), run(hexa, 40).upper()])
            return (cue.upper() if rng.random() < 0.15 else cue), body
        c = luhn(16, True)
        return rng.choice(["card ", "visa ", "paid with "]), "/".join(c[i : i + 4] for i in range(0, 16, 4))

    def harmless() -> tuple[str, str]:
        kind = rng.randrange(12)
        if kind == 0:
            return rng.choice(["", "user ", "by "]), f"{name()}@{digits(4)}"
        if kind == 1:
            return rng.choice(["", "in ", "order ", "total "]), digits(rng.randint(7, 24))
        if kind == 2:
            return rng.choice(["", "on ", "since "]), f"20{digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}"
        if kind == 3:
            return rng.choice(["version ", "section ", "build "]), ".".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(4, 6))) + digits(3)
        if kind == 4:
            return "isbn ", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"
        if kind == 5:
            return 'token = "a', digits(rng.randint(7, 14))
        if kind == 6:
            return rng.choice(["", "id ", "serial "]), luhn(16, False)
        if kind == 7:
            return rng.choice(["", "serial ", "hash "]), "AB" + digits(2) + " " + " ".join("".join(rng.choice("ABCDEF0123456789") for _ in range(4)) for _ in range(2))
        if kind == 8:
            return rng.choice(["commit ", "sha256: ", "md5 ", "checksum ", "etag \"", "hash "]), run("0123456789abcdef", rng.choice([32, 40, 64]))
        if kind == 9:
            return rng.choice(["", "see ", "/", "uuid "]), "-".join(name() for _ in range(rng.randint(3, 6))) + f"-{rng.randint(1, 99)}" if rng.random() < 0.5 else "-".join(run("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
        if kind == 10:
            return rng.choice(["", "the ", "= "]), rng.choice(["-", "=", "_"]) * rng.randint(16, 60) + digits(1) if rng.random() < 0.5 else name() * 4 + digits(2) + name()
        return rng.choice(["", "matrix "]), " ".join(digits(rng.randint(1, 2)) for _ in range(rng.randint(7, 14)))

    out = []
    for i in range(n):
        label = i % 2
        cue, body = private() if label else harmless()
        head = " ".join(rng.choice(words) for _ in range(rng.randint(2, 6))) + rng.choice([" ", ". ", ",\n", " "])
        tail = rng.choice(["", ".", ","]) + " " + " ".join(rng.choice(words) for _ in range(3))
        if label == 0 and cue.startswith("token"):
            tail = 'f3"' + tail
        out.append((i, head + cue + body + tail, len(head + cue), len(head + cue + body), label))
    return out


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    value = float(grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return value
    best = (1e-6, None)
    base = grad.sum() ** 2 / (hess.sum() + 1)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1) - base
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    if best[1] is None:
        return value
    j, at = best[1]
    low = x[:, j] <= at
    return (j, at, _grow(x[low], grad[low], hess[low], depth - 1), _grow(x[~low], grad[~low], hess[~low], depth - 1))


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, at, low, high = tree
    return np.where(x[:, j] <= at, tree_values(low, x), tree_values(high, x))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees on three quarters of the rows; calibration and thresholds on the rest."""
    held = np.arange(len(x)) % 4 == 3
    tx, ty = x[~held], y[~held]
    score, trees = np.zeros(len(tx)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(tx, ty - p, p * (1 - p), DEPTH)
        trees.append(tree)
        score += RATE * tree_values(tree, tx)
    z = RATE * sum(tree_values(t, x[held]) for t in trees)
    hy = y[held]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling, with smoothed labels
        t = (hy * (hy.sum() + 1) + (1 - hy)) / np.where(hy == 1, hy.sum() + 2, len(hy) - hy.sum() + 2)
        q = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a + 0.5 * float(((t - q) * z).mean()), b + 0.5 * float((t - q).mean())
    q = 1 / (1 + np.exp(-(a * z + b)))
    limits = {}
    for i, kind in enumerate(PROPOSE):
        own = x[held][:, 0] == i
        order = np.argsort(-q[own], kind="stable")
        right = np.cumsum(hy[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(0.5, float(q[own][order][good[-1]])) if len(good) else 2.0
    accuracy = float(((q >= 0.5) == (hy == 1)).mean())
    return {"trees": trees, "a": a, "b": b, "limits": limits, "accuracy": accuracy, "held": int(held.sum())}


_fitted: dict[str, dict] = {}


def fitted(spark: SparkSession) -> dict:
    if "model" not in _fitted:
        rows = spark.createDataFrame(examples(), "doc_id long, text string, a int, b int, label int")
        found = _with_text(rows).withColumn("c", F.explode(candidates())).select("doc_id", "c.*").join(rows.select("doc_id", "a", "b", "label"), "doc_id")
        # A proposal is a labelled example if it overlaps the span that was put in.
        found = found.where("start < b and a < end").orderBy("doc_id", "start", "end", "kind").select("f", F.expr("case when label = 1 and start <= a and end >= b - 3 then 1 else 0 end").alias("y")).collect()
        _fitted["model"] = fit(np.array([r["f"] for r in found]), np.array([float(r["y"]) for r in found]))
    return _fitted["model"]


def _case(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(round(tree, 9))
    j, at, low, high = tree
    return F.when(f[j] <= at, _case(low, f)).otherwise(_case(high, f))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of each row."""
    m = fitted(docs.sparkSession)
    rows = _with_text(docs)
    for kind in KINDS:
        hits = F.filter(_found(BASE[kind], kind, NEEDS[kind]), partial(_passes, kind))
        rows = rows.withColumn(f"_{kind}", F.transform(hits, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = rows.withColumn("_base", F.concat(*(F.col(f"_{k}") for k in KINDS)))

    def logit(p: float) -> float:
        return math.inf if p >= 1 else (math.log(p / (1 - p)) - m["b"]) / m["a"]

    def score(x):
        total = F.lit(0.0)
        for tree in m["trees"]:
            total = total + _case(tree, x["f"])
        return RATE * total

    limit = F.create_map(*(F.lit(v) for k in PROPOSE for v in (k, logit(m["limits"][k]))))
    free = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = rows.withColumn("_c", F.when(F.col("_digit") | F.contains("_t", F.lit("@")) | F.contains(F.lower("_t"), F.lit("dot")), F.filter(candidates(), free)))
    rows = rows.withColumn("_s", F.transform("_c", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["name"].alias("name"), score(x).alias("score"))))
    rows = rows.withColumn("_s", F.filter("_s", lambda x: x["score"] >= F.element_at(limit, x["kind"])))
    better = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["kind"] < x["kind"])))))
    rows = rows.withColumn("_more", F.filter("_s", lambda x: ~F.exists("_s", lambda y: better(x, y))))
    named = F.transform("_more", lambda x: F.struct(x["name"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.withColumn("_named", F.coalesce(named, F.slice("_base", 1, 0)))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        both = F.concat(F.col(f"_{kind}") if kind in KINDS else F.slice("_base", 1, 0), F.filter("_named", lambda x: x["kind"] == kind))
        return F.array_sort(both, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))

    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.concat(*(of(k) for k in [*KINDS, *MORE]))).alias("spans"), (F.size("_base") + F.size("_named")).cast("long").alias("n_spans"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
