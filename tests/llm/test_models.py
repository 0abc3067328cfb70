"""Estimates, forests and the personal-data model against exact or planted results."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import mixing, pii, quality, vectors
from tests.llm.conftest import words


def test_limit_is_the_chi_square_quantile():
    assert abs(quality.chi_square_limit(0.001) - 20.515) < 0.01 and abs(quality.chi_square_limit(0.05) - 11.0705) < 0.001


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_estimate_is_near_the_exact_one(spark, seed):
    """On a group small enough to try every subset: the determinant is about the least one, and planted rows lie beyond the limit."""
    rng = np.random.default_rng(seed)
    mixed = np.eye(5) + 0.3 * rng.standard_normal((5, 5))
    x = rng.standard_normal((16, 5)) @ mixed * 2
    planted = [3, 11, 14]
    x[planted] += rng.choice([-1, 1], (3, 5)) * 200
    x = np.vstack([x + 1e-3 * rng.standard_normal(x.shape) for _ in range(4)])
    rows = spark.createDataFrame([("l", "s", *map(float, r)) for r in x], "lang_key string, source_key string, x0 double, x1 double, x2 double, x3 double, x4 double")
    subsets = ([i + 16 * k for i in pick for k in range(4)] for pick in itertools.combinations(range(16), 12))
    exact = min(quality._estimate(x[at].mean(axis=0), np.cov(x[at].T, bias=True))[0] for at in subsets)
    model = quality.robust_models(rows)
    inverse = np.array(model.first().model[5:30]).reshape(5, 5)
    assert -np.linalg.slogdet(inverse)[1] <= exact + 1.0
    far = {r.x0 for r in rows.join(model.select("model"), F.lit(True)).withColumn("d", quality._distance()).where(F.col("d") > quality.LIMIT).collect()}
    assert far >= {float(x[i + 16 * k, 0]) for i in planted for k in range(4)} and len(far) <= 20


def test_vectors_of_any_magnitude_link(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e200, 2.0000001e200]), (3, [1e-300, 2e-300]), (4, [5.0, -1.0])]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in (1, 2, 3, 4)] == [2, 2, 2, 0] and got[3].component_id == 1


def test_large_leaves_are_split_again(spark):
    """Leaves of 16 rows in a table of 3,000: several rounds of splits, and still nearly all links."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1000, 24))
    x = np.vstack([base + 0.08 * rng.standard_normal(base.shape) for _ in range(3)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum() - len(x)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    forest = vectors.fit_forest(x[:64], 64, 12, leaf_rows=64)
    assert all(t["root"] < 0 for t in forest)
    before, vectors.SAMPLE = vectors.SAMPLE, 64  # the first trees are shallow
    try:
        got = vectors.near_vectors(rows, leaf_rows=64).agg(F.sum("n_links")).first()[0]
    finally:
        vectors.SAMPLE = before
    assert want > 3000 and 0.97 * want <= got <= want


def test_personal_data_of_each_kind_is_found(spark):
    """Recall by kind on forms and sentences that the model's own examples don't hold."""
    rng = random.Random(5)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    forms = {
        "secret": lambda: rng.choice([f'config token = "{hexa(40)}" loaded', f"use api_key={hexa(32)} here", "key AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) + " was leaked", f'TOKEN = "{hexa(40).upper()}"!!']),
        "email": lambda: rng.choice([f"reach jane.roe{digits(2)} (at) firm (dot) org today", "JOE (AT) SITE (DOT) COM", f"ask x{digits(2)}@host.example.net please"]),
        "phone": lambda: rng.choice([f"phone: ({digits(3)}) {digits(3)}-{digits(4)} after six", f"tel {digits(3)}-{digits(3)}-{digits(4)} now", f"call +49 {digits(3)} {digits(7)} soon"]),
        "identity": lambda: f"her ssn {digits(3)}-{digits(2)}-{digits(4)} is on file",
        "account": lambda: f"iban DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)} for rent",
    }
    rows = [(kind, f"{' '.join(words(rng, 8))} {make()} {' '.join(words(rng, 8))}") for kind, make in forms.items() for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    for kind in forms:
        at = [i for i, (k, _) in enumerate(rows) if k == kind]
        recall = sum(f"{kind}:" in got[i] for i in at) / len(at)
        print(f"recall {kind}: {recall:.3f}")
        assert recall >= 0.9, kind
    clean = spark.createDataFrame([(i, " ".join(words(rng, 60)) + f" in {1900 + i} the commit {hexa(40)} of build 4.{i}.1 and state-of-the-art-{i} things") for i in range(60)], "doc_id long, text string")
    assert sum(r.n_spans > 0 for r in pii.find_pii(clean).collect()) <= 3


def test_tokens_of_the_documents_are_found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = pii.find_pii(docs).join(docs, "doc_id").where(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).select("doc_id", "text", "spans").collect()
    for r in rows:
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text):
            assert f"secret:{m.start(1)}:{m.end(1)}" in r.spans.split(",")


def test_mixing_takes_rows_without_ids_as_often_as_the_mix_says(spark, make, data):
    rng = random.Random(6)
    rows = [(None, " ".join(words(rng, 20 + i % 7)), "en", "a") for i in range(40)] + [(i, " ".join(words(rng, 30)), "en", "b") for i in range(60)]
    rows += [(None, "the same words again", "en", "b")] * 5
    docs = make(rows)
    mixed = mixing.mix(docs)
    want = {r.size: r.n for r in mixed.groupBy("size").agg(F.sum("repeats").alias("n")).where("n > 0").collect()}
    out = P.mixing_to_targets(spark, docs, data)
    got = {r.size: r["count"] for r in out.select(F.size(F.split("text", " ")).cast("long").alias("size")).groupBy("size").count().collect()}
    assert got == want and out.columns == docs.columns


@pytest.mark.parametrize("stage", [n for n, _ in P.STAGES])
def test_stages_on_edge_rows_and_an_empty_table(spark, make, edge, data, stage):
    run = dict(P.STAGES)[stage]
    out = run(spark, edge, data)
    assert set(out.columns) >= set(edge.columns) and out.count() <= 3 * edge.count()
    assert run(spark, make([]), data).count() == 0


def test_quality_stage_tells_texts_of_one_id_apart(spark, make, data):
    rng = random.Random(2)
    good = " ".join(words(rng, 200))
    got = [(r.doc_id, r.text) for r in P.quality_rules(spark, make([(1, good), (1, "too short"), (None, "short"), (None, good)]), data).collect()]
    assert sorted(got, key=str) == sorted([(1, good), (None, good)], key=str)
