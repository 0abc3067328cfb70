"""Operators against brute force, exact round trips and planted cases."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import catalog, chains, lines, minhash, mixing, pages, pieces, pii, quality, suffixes, vectors
from millrace.llm.seeds import over_neighbours
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _mutated(rng, base, rate):
    return [f"x{rng.randrange(10**6)}" if rng.random() < rate else w for w in base]


def test_minhash_finds_every_link(make, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "BLOCK", 6)
    rows = []
    for _ in range(12):
        base = words(rng, rng.randint(30, 200))
        rows += [" ".join(_mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.1]))) for _ in range(rng.choice([1, 3, 30]))]
    rows = [(i, t) for i, t in enumerate(rows)]
    sets = {i: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for i, t in rows for w in [t.lower().split()]}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r for r in minhash.near_duplicates(make(rows), k=3, percent=85).collect()}
    assert {i: r.component_id for i, r in got.items()} == _components(sets, links) and len(links) > 50
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())


def test_minhash_default_is_five_words(make):
    rng = random.Random(1)
    base = words(rng, 400)
    near, far = base[:], base[:]
    near[200] = "other"
    for i in range(0, 400, 20):
        far[i] = f"y{i}"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make([(1, " ".join(base)), (2, " ".join(near).upper()), (3, " ".join(far))])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_statistics_and_verdicts(docs, texts):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in texts.items():
        w = WORD.findall(t)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often, cover = Counter(windows), set()
        for j, g in enumerate(windows):
            if often[g] > 1:
                cover |= {j, j + 1, j + 2}
        rows = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(rows) - len(set(rows)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and (not r.base_failed or not r.kept)


def test_outliers_go_and_clean_texts_stay(make):
    rng = random.Random(2)
    clean = [(i, " ".join(words(rng, rng.randint(60, 300), 5000))) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in words(rng, 100, 5000))) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.quality(make(clean + junk)).collect()}
    assert not any(got[i] for i, _ in junk) and sum(got[i] for i, _ in clean) >= 297


def test_line_groups(make):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(24, 60))) for _ in range(40)]

    def edit(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s))
            o = rng.randrange(3)
            if o == 0:
                s[k] = rng.choice("xyz")
            elif o == 1:
                s.insert(k, "q")
            else:
                s.pop(k)
        return "".join(s)

    rows = [(i, "\n".join(edit(rng.choice(base)) if rng.random() < 0.7 else rng.choice(["", "short", "  "]) for _ in range(6))) for i in range(60)]
    every = defaultdict(list)
    for i, t in rows:
        for n, x in enumerate(t.split("\n")):
            if len(x) >= lines.SHORTEST and WORD.search(x):
                every[x].append((i, n))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    keys = sorted(every)
    links = [(a, b) for a in keys for b in keys if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    groups = defaultdict(list)
    for x, c in _components(keys, links).items():
        groups[c] += every[x]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    expected = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}
    assert {r.doc_id: r.text for r in lines.without_duplicate_lines(make(rows)).collect()} == expected and len(links) > 20


def test_short_lines(make):
    rng = random.Random(14)
    seen = ["Menu", "x", "Read more", "by A. Author", "by A. Authot", "by B. Authot"]  # limits 0 to 9 characters, 1 to 19
    for n in range(8, 23):  # about both limits
        base = "".join(rng.choice("abcdef") for _ in range(n))
        seen += [base, base[:4] + "Q" + base[5:], base[:-2], base[:3] + base[4:], "Z" + base]
    rows = [(i, "\n".join(rng.sample(seen, 30) + ["", " "])) for i in range(12)]
    every = defaultdict(list)
    for i, t in rows:
        for n, x in enumerate(t.split("\n")):
            if WORD.search(x):
                every[x].append((i, n))

    def linked(a, b):
        n = min(len(a), len(b))
        limit = 2 if n >= 20 else 1 if n >= 10 else 0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1] <= limit

    keys, groups = sorted(every), defaultdict(list)
    for x, c in _components(keys, [(a, b) for a in keys for b in keys if a < b and linked(a, b)]).items():
        groups[c] += every[x]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    expected = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}
    assert {r.doc_id: r.text for r in lines.without_duplicate_lines(make(rows)).collect()} == expected


def test_banded_distance(spark):
    rng = random.Random(9)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(5, 30))), "".join(rng.choice("ab") for _ in range(rng.randint(5, 30)))) for _ in range(60)] + [("abcdef" * 8, "abcdef" * 8), ("x" * 30, "x" * 28)]
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "levenshtein(a, b) as d").withColumn("g", lines.banded_distance("a", "b"))
    assert all(min(r.d, 3) == min(r.g, 3) for r in df.collect())


def test_repeated_passages_are_exact(docs, texts):
    at, cover = defaultdict(list), defaultdict(set)
    for i, t in texts.items():
        w = t.encode().split()
        for p in range(len(w) - 49):
            at[tuple(w[p : p + 50])].append((i, p))
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                cover[i] |= set(range(p, p + 50))
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in suffixes.repeated_passages(docs).collect()}
    assert got == dict(cover)


def test_neighbours_over_task_borders(spark):
    def compare(rows):
        h, d = (np.asarray(rows.column(c)) for c in ("h", "d"))
        at = np.flatnonzero(h[1:] == h[:-1])
        return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(d[at + 1])], ["a", "b"])

    rows = spark.createDataFrame([(5, i) for i in range(3000)] + [(6, 1), (7, 2), (7, 3)], "h long, d long")
    got = {(r.a, r.b) for r in over_neighbours(rows, ["h", "d"], 1, compare, "a long, b long", "test").collect()}
    assert got >= {(i, i + 1) for i in range(2999)} | {(2, 3)} and (2999, 1) not in got and (1, 2) in got


def test_fuzzy_passages(make):
    rng = random.Random(8)
    passage = words(rng, 120, 10**6)
    rows = [(i, " ".join(words(rng, 150, 10**6) + _mutated(rng, passage, 0.03) + words(rng, 80, 10**6))) for i in range(12)]
    rows += [(100 + i, " ".join(words(rng, 300, 10**6))) for i in range(10)]
    got = {r.doc_id: r for r in chains.fuzzy_passages(make(rows)).collect()}
    assert set(got) == set(range(12)) and all(r.component_id == 0 for r in got.values())
    for r in got.values():
        assert all(abs(s.start - 150) <= 12 and abs(s.end - 270) <= 12 for s in r.spans)


def test_passages_about_a_replaced_block(make):
    rng = random.Random(18)
    rows, at = [], {}
    for k, (left, gap, right) in enumerate([(100, 60, 100), (150, 90, 150), (300, 160, 300), (450, 300, 450)] * 4):
        one, two = words(rng, left, 10**6), words(rng, right, 10**6)
        for i, between in ((2 * k, gap), (2 * k + 1, gap if k < 8 else 0)):
            rows.append((i, " ".join(words(rng, 30, 10**6) + one + words(rng, between, 10**6) + two + words(rng, 30, 10**6))))
            at[i] = set(range(30, 30 + left)) | set(range(30 + left + between, 30 + left + between + right))
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in chains.fuzzy_passages(make(rows)).collect()}
    assert all(len(p & got.get(i, set())) >= len(p) - 5 for i, p in at.items())


def test_chain_prefers_collinear_anchors():
    x = np.array([0, 7, 14, 15, 21, 28])
    y = np.array([100, 107, 114, 3, 121, 128])
    assert chains.chain(x, y)[0] == [0, 1, 2, 4, 5]


def test_forest_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 32))
    near = base[rng.integers(0, 1500, 400)] + rng.standard_normal((400, 32)) * 0.12
    tight = base[0] + rng.standard_normal((150, 32)) * 0.02
    x = np.vstack([base, near, tight]).astype(np.float32)
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    n = linked.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.9 * n.sum()


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_is_exact_and_more_is_found(docs, make):
    odd = ["a@b.c%d@e.f x", "@@a@b..c a@b.c.", "1.2.3.4.5.6.7.8 1.2.3.256 001.02.3.4", "4111 1111 1111 1111 4111111111111111-", "+1 (017) 555-7713 +1+2 +12345678901234567 + 1", "héé a@b.co é 1.1.1.1\n😀 x@y.zz", "12345678901234 " * 3, "plain words only"]
    more = ["write to joe (at) site (dot) com now", "call 555-123-4567 today", "iban DE12 3456 7890 1234 5678 90 ok"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10**6 + i, t) for i, t in enumerate(odd + more)]
    texts = dict(rows)
    for r in pii.find_pii(make(rows)).collect():
        base = _base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in BASE]
        if r.doc_id >= 10**6 + len(odd):
            assert len(spans) == 1
    model = pii.fitted(docs.sparkSession)
    assert model["accuracy"] >= 0.95 and model["held"] > 300


def test_pieces_equal_the_library(texts):
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.model(pieces.MODEL)
    rng = random.Random(1)
    odd = ["".join(rng.choice("aebtho  \n\t▁é😀ﬁ一.,12ABn") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", " ", " " * 40 + "x", "def f(x):\n    return  x\n", "x" * 3000, "the tokenization of indivisible words"]
    every = list(texts.values()) + odd
    assert [x.tolist() for x in model.encode(every)] == library.encode(every)
    assert all(model.decode(i.tolist()) == t.replace("▁", " ") for i, t in zip(model.encode(every), every, strict=True))


def test_unigram_takes_the_best_score():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -2.2, "ab": -3.1, "bc": -2.9, "▁a": -2.6, "abc": -6.0, "▁ab": -4.4}
    model = pieces.Model(scores.items(), kind="unigram")

    def best(w):
        if not w:
            return 0.0
        return max((scores[w[:i]] + best(w[i:]) for i in range(1, len(w) + 1) if w[:i] in scores), default=-1e9)

    name = {i: p for p, i in model.ids.items()}
    rng = random.Random(2)
    for _ in range(100):
        w = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        ids = model.encode_words([w, w[:2]])[w]
        assert "".join(name[i] for i in ids) == w and abs(sum(scores[name[i]] for i in ids) - best(w)) < 1e-9


def test_decoded_rows(spark):
    rows = spark.createDataFrame([(1, "Ein Satz,  zwei."), (2, "")], "doc_id long, text string")
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(rows).drop("text")).collect()}
    assert back == {1: "Ein Satz,  zwei.", 2: ""}


def test_fit_counts_against_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(0, 60): rng.randint(1, 5) for _ in range(rng.randint(1, 10))}
        total = sum(k * v for k, v in counts.items())
        budget = rng.randint(0, total + 5)
        take = mixing.fit_counts(counts, budget)
        reach = {0}
        for k, v in counts.items():
            for _ in range(v):
                reach |= {x + k for x in reach}
        assert all(take[k] <= counts[k] for k in take) and sum(k * v for k, v in take.items()) == max(x for x in reach if x <= budget)


def _targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 3 * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def test_mix_targets_and_reruns(make):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.choice([40, rng.randint(1, 400)]))), "en", rng.choice(["a"] * 20 + ["b", "c", "d", "é", None])) for i in range(900)]
    first, again = (sorted(tuple(r) for r in mixing.mix(make(rows).repartition(n)).collect()) for n in (1, 5))
    assert first == again
    got = {r[0]: r for r in first}
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    order = sorted(x for x in sizes if x is not None) + [None]
    for source, target in zip(order, _targets([sizes[s] for s in order]), strict=True):
        own = [got[i] for i, _, _, s in rows if s == source]
        assert all(abs(r[3] - target) < 1e-6 * max(1, target) and r[2] == sizes[source] for r in own)
        assert abs(sum(r[5] for r in own) - target) <= 60
    assert all(r[5] <= 3 * r[1] for r in first)


def test_hot_sizes_are_chosen_exactly(make, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 4)
    rows = [(i, "one two three", "en", "a") for i in range(500)] + [(1000 + i, "x " * 30, "en", "b") for i in range(10)]
    got = mixing.mix(make(rows)).collect()
    a = [r for r in got if r.doc_id < 1000]
    assert abs(sum(r.taken for r in a) - a[0].target) <= 3 and len({r.taken for r in a}) <= 2


def test_page_text_and_templates(spark):
    def page(i, n=6):
        return f"<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='promo-box'>buy</div><div><p>Same words on each page of this site.</p></div><article><h1>Head {i}</h1><p>Body &amp; soul {i}<br>next<p>More <b>bo</b>ld {i}</p><p>Shared line.</p><section class=comments>first!</section></article><footer>f</footer></body></html>"

    def plain(i):
        return f"<body><div class=main><div>Welcome to our site, friend.</div><p>Text {i} of\n the   page.</p><form>f</form></div></body>"

    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(12)] + [(100 + i, f"https://B.org:8080/{i}", plain(i)) for i in range(12)] + [(200 + i, f"http://copies.org/{i}", plain(0)) for i in range(20)] + [(300 + i, f"http://few.org/{i}", plain(i)) for i in range(3)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3 Body & soul 3 next More bold 3"
    assert got[105] == "Text 5 of the page."
    assert got[203] == "Welcome to our site, friend. Text 0 of the page." and got[301] == "Welcome to our site, friend. Text 1 of the page."


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_reference_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, data)
    got = c.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(got.fetchall()) and sorted(names) == sorted(df.columns)


def test_given_pages(spark, data):
    for r in pages.main_text(spark.read.parquet(f"{data}/pages.parquet")).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        body = re.sub(r"<[A-Za-z/!][^<>]*\Z", "", m[1]) if m else ""
        expected = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br|div)[^>]*>", " ", body))).split())
        assert r.text == expected and r.n_chars == len(expected)
