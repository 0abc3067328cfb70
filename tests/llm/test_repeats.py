"""One id with several texts, hot templates and frequent passages, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import chains, lines, minhash, suffixes
from tests.llm.conftest import words


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lines_of_two_texts_with_one_id(make):
    rng = random.Random(3)
    shared, one, two = (" ".join(words(rng, 12)) for _ in range(3))
    docs = make([(1, f"{shared}\n{one}"), (1, f"{two}\n{shared}"), (2, shared), (0, "other line\n" + shared)])
    got = sorted((r.doc_id, r.text) for r in lines.without_duplicate_lines(docs).collect())
    assert got == sorted([(0, "other line\n" + shared), (1, one), (1, two), (2, "")])


def test_lines_of_a_hot_template(make):
    rng = random.Random(4)
    rows = [(i, f"Order number {rng.randrange(10**7):07d} has been shipped to you") for i in range(700)] + [(1000 + i, " ".join(words(rng, 9))) for i in range(50)]
    rows += [(2000 + i, rows[i][1].replace("shipped", "shiped")) for i in range(20)]
    texts = [t for _, t in rows]
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if abs(len(texts[i]) - len(texts[j])) <= 2 and sum(abs(texts[i].count(c) - texts[j].count(c)) for c in "0123456789sh") <= 4 and _distance(texts[i], texts[j]) <= 2:
                a, b = sorted((find(i), find(j)))
                head[b] = a
    want = {rows[i][0] for i in range(len(rows)) if find(i) == i}
    got = {r.doc_id for r in lines.without_duplicate_lines(make(rows)).collect() if r.n_dropped == 0}
    assert got == want


def _links(texts, k, percent):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("changed", [3, 7, 11])
def test_large_buckets_of_near_copies(make, monkeypatch, changed):
    """Copies around the threshold, among them pairs that are near only through others, in buckets of many blocks."""
    monkeypatch.setattr(minhash, "SMALL", 6)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(changed)
    base, rows = words(rng, 200, 10_000), []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(changed + 1)):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(500 + i, " ".join(words(rng, 150, 10_000))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows), k=3, percent=85).collect()}
    want = _links([t for _, t in rows], 3, 85)
    assert got == {rows[i][0]: rows[want[i]][0] for i in range(len(rows))}


def test_two_texts_of_one_id_are_compared_apart(make):
    rng = random.Random(9)
    one, two = (" ".join(words(rng, 100)) for _ in range(2))
    rows = minhash.near_duplicates(make([(5, one), (5, two), (3, one + " more"), (7, two + " more")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (5, 3), (5, 5), (7, 5)]


def _mutated(rng, passage, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in passage]


def _filler(rng, n=40):
    return words(rng, n, 10**6)


def test_passage_whose_halves_are_frequent(make):
    rng = random.Random(21)
    one, two = words(rng, 40, 10**6), words(rng, 40, 10**6)
    rows = [(i, " ".join(_filler(rng) + one + two + _filler(rng))) for i in (50, 51)]
    for k, half in enumerate((one, two)):
        rows += [(i, " ".join(_filler(rng) + half + _filler(rng))) for i in [*range(10 + 5 * k, 14 + 5 * k), *range(90 + 5 * k, 94 + 5 * k)]]
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in chains.fuzzy_passages(make(rows)).collect()}
    assert set(got) == {50, 51} and all(len(p & set(range(40, 120))) >= 78 for p in got.values())


@pytest.mark.parametrize(("length", "quote"), [(60, 20), (60, 24), (80, 24), (120, 30)])
def test_passage_whose_parts_are_quoted(make, length, quote):
    """Every whole copy is found although each part has places of lower and higher ids."""
    rng = random.Random(length + quote)
    rows, whole = [], {}
    for c in range(8):
        passage = words(rng, length, 10**6)
        quotes = [passage[i : i + quote] for i in range(0, length - quote + 1, quote // 2)]
        ids = list(range(1000 * c, 1000 * c + 11 + 2 * len(quotes)))
        for i, q in zip(ids[: len(quotes)] + ids[-len(quotes) :], quotes * 2, strict=True):
            rows.append((i, " ".join(_filler(rng) + q + _filler(rng))))
        for i in ids[len(quotes) : -len(quotes)]:
            rows.append((i, " ".join(_filler(rng) + passage + _filler(rng))))
            whole[i] = c
    got = {r.doc_id: r for r in chains.fuzzy_passages(make(rows)).collect()}
    assert set(got) == set(whole)
    assert all(len({r.component_id for i, r in got.items() if whole[i] == c}) == 1 for c in range(8))


@pytest.mark.parametrize(("length", "share", "least"), [(60, 0.0, 1.0), (60, 0.05, 0.95), (80, 0.05, 0.97), (80, 0.1, 0.85), (120, 0.1, 0.95)])
def test_recall_of_fuzzy_pairs(make, length, share, least):
    """Of pairs whose copies are alike enough by their common words, the share found."""
    rng = random.Random(int(length + 100 * share))
    rows, pairs = [], []
    for c in range(60):
        passage = words(rng, length, 10**6)
        copy = _mutated(rng, passage, share)
        inner = [i for i in range(length) if passage[i] == copy[i]]
        if inner[-1] - inner[0] + 1 < 50 or len(inner) < 0.85 * length:
            continue
        pairs.append(2 * c)
        rows += [(2 * c, " ".join(_filler(rng) + passage + _filler(rng))), (2 * c + 1, " ".join(_filler(rng, 25) + copy + _filler(rng)))]
    got = {r.doc_id: r.component_id for r in chains.fuzzy_passages(make(rows)).collect()}
    found = sum(got.get(i) == i and got.get(i + 1) == i for i in pairs) / len(pairs)
    print(f"recall {length} words, {share} changed: {found:.3f} of {len(pairs)}")
    assert found >= least


def test_passages_around_a_frequent_phrase(make):
    """Pairs that agree to the left of a 16-word phrase that very many texts hold, each with words of its own after it."""
    rng = random.Random(31)
    phrase, rows, cover = words(rng, 16, 10**6), [], {}
    for c in range(60):
        left = words(rng, 36, 10**6)
        for i in (c, 500 + c):
            rows.append((i, " ".join(_filler(rng, 30) + left + phrase + _filler(rng, 60))))
            cover[i] = set(range(30, 82))
    rng.shuffle(rows)
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in suffixes.repeated_passages(make(rows)).collect()}
    assert got == cover


def test_passages_in_two_texts_of_one_id(make):
    rng = random.Random(41)
    one, two = words(rng, 60, 10**6), words(rng, 60, 10**6)
    rows = [(5, " ".join(one + _filler(rng))), (5, " ".join(two + _filler(rng))), (3, " ".join(_filler(rng) + one)), (9, " ".join(_filler(rng) + two))]
    for op in (chains.fuzzy_passages, suffixes.repeated_passages):
        assert sorted((r.doc_id, r.component_id) for r in op(make(rows)).collect()) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_every_link_of_frequent_fuzzy_copies(make):
    """Two altered copies of a passage: other texts quote each alteration with the words about it, so the copies stand apart in every order."""
    rng = random.Random(77)
    rows, pairs = [], []
    for c in range(8):
        base = 1000 * c
        parts = [words(rng, 12, 10**6) for _ in range(6)]
        for v in range(2):
            joints = [words(rng, 1, 10**6) for _ in range(5)]
            whole = parts[0] + [w for j, p in zip(joints, parts[1:], strict=True) for w in j + p]
            rows.append((base + 500 + v, " ".join(_filler(rng) + whole + _filler(rng))))
            for k in range(50):
                i = k % 5
                rows.append((base + (k if k < 25 else 900 + k) + 100 * v * (k < 25), " ".join(_filler(rng) + parts[i] + joints[i] + parts[i + 1] + _filler(rng))))
        pairs.append((base + 500, base + 501))
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    got = {r.doc_id: r.component_id for r in chains.fuzzy_passages(make(rows)).collect()}
    assert got == {i: p[0] for p in pairs for i in p}


def test_settled_copies_do_not_meet_again(make):
    """Nothing is left to the second pass where all places of a passage's seeds are in passages of one component, those of its least document too."""
    rng = random.Random(83)
    passage = words(rng, 80, 10**6)
    texts = make([(i, " ".join(_filler(rng) + passage + _filler(rng))) for i in range(12)]).selectExpr("doc_id as d", "text")
    seeds = texts.mapInArrow(chains.seed_rows(chains.GRAM, chains.WINDOW, chains.LEAST, True), "h long, d long, pos int")
    counts = seeds.groupBy("h").count().where("count > 1").withColumnRenamed("count", "n")
    places = chains.materialize(seeds.join(counts, "h").select("h", "d", "pos", "n"), "test-places")
    passages = texts.sparkSession.createDataFrame([(a, 40, 120, b) for i in range(1, 12) for a, b in ((0, i), (i, 0))], "d long, start int, end int, other long")
    assert places.count() > 12 * chains.ANCHORS and chains._rest(places, passages).isEmpty()


def test_chains_with_too_few_matches_have_no_passage():
    """A chain left out before it is aligned has no passage, and one of a short line between other words is left out."""
    rng = random.Random(89)
    left_out = 0
    for c in range(400):
        line = [rng.randrange(3 if c % 4 == 0 else 10**6) for _ in range(rng.randint(9, 45))]
        whole = [rng.randrange(8 if c % 2 else 10**6) for _ in range(70)]
        a, b = (np.array(whole[: c % 70] + [rng.randrange(9) for _ in range(rng.randint(0, 9))] + line + whole[: (7 * c) % 70] + [rng.randrange(10**6) for _ in range(rng.randint(0, 90))], np.uint32) for _ in range(2))
        at = [(x, y) for x in range(len(a) - 5) for y in range(len(b) - 5) if a[x] == b[y] and (a[x : x + 6] == b[y : y + 6]).all() and rng.random() < 0.4]
        for path in chains.chain(*(np.array(v) for v in zip(*at, strict=True))) if at else []:
            xs, ys = [at[i][0] for i in path], [at[i][1] for i in path]
            few = chains.too_few(a, b, xs, ys) or chains.too_few(b, a, ys, xs)
            left_out += few
            assert not (few and chains.align(a, b, xs, ys))
    assert left_out > 20


def test_pairs_of_settled_seeds_are_not_written():
    """Of ten seeds side by side one isn't settled: nine pairs are written, all with it, and no row for a place by itself."""
    n = 10
    cols = [np.full(n, 7), np.arange(0, 3 * n, 3, np.int32), np.arange(100, 100 + n), np.arange(n) == 4, np.arange(n) == 4, np.arange(n) != 4, np.full(n, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d", "pos", "h", "open", "unsettled", "known", "of"])
    rows = [r for b in chains._next_to(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["a"], r["b"]) for r in rows) == [*((3 * i, 12) for i in range(4)), *((12, 3 * i) for i in range(5, n))]
    assert all(r["fa"] == (r["a"] == 12) and r["fb"] == (r["b"] == 12) and r["of"] is None for r in rows)


def test_second_pass_in_parts(make, monkeypatch):
    """Anchors and chains of a part of the pairs are on disk at once; the result is that of all at once."""
    rng = random.Random(97)
    line = words(rng, 20, 10**6)
    passages = [words(rng, 60, 10**6) for _ in range(20)]
    rows = [(i, " ".join(_filler(rng) + line + (passages[i // 4] if i % 2 else []) + _filler(rng))) for i in range(80)]
    tables, real = [], chains.materialize

    def kept(df, label):
        tables.append((label, out := real(df, label)))
        return out

    monkeypatch.setattr(chains, "materialize", kept)
    monkeypatch.setattr(chains, "discard", lambda df: None)
    one = sorted(tuple(r) for r in chains.fuzzy_passages(make(rows)).collect())
    met = [df for label, df in tables if label == "open-pairs"][0].count()
    assert met > 300 and len([1 for label, _ in tables if label == "chains"]) == 2
    monkeypatch.setattr(chains, "EACH", 0)
    monkeypatch.setattr(chains, "AT_ONCE", met // 3 + 1)
    tables.clear()
    assert sorted(tuple(r) for r in chains.fuzzy_passages(make(rows)).collect()) == one
    parts = [df.select("d", "other").distinct().count() for label, df in tables if label == "chains"][1:]
    assert len(parts) == 3 and max(parts) < met / 2
    assert {i for i, *_ in one} >= {i for i in range(80) if i % 2}
