"""The pipeline's stages and what they promise of their own input."""

import random

import corpus_pipeline as P
from millrace.llm import catalog
from millrace.llm.common import connected_components
from tests.llm.conftest import words


def test_stages_on_planted_documents(spark, make, data):
    rng = random.Random(11)
    clean = [(i, "\n".join(" ".join(words(rng, 15, 20_000)) for _ in range(10)), "en", rng.choice(["a", "b"])) for i in range(120)]
    copies = [(1000 + i, clean[i][1], "en", "a") for i in range(5)]
    near = [(2000 + i, clean[10 + i][1].replace(clean[10 + i][1].split()[3], "new", 1), "en", "b") for i in range(5)]
    junk = [(3000 + i, " ".join(f"{w}$$$" for w in words(rng, 150)), "en", "a") for i in range(5)]
    docs = make(clean + copies + near + junk)
    kept = P.quality_rules(spark, docs, data)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in clean + copies + near}
    assert kept.columns == docs.columns
    one = {r.doc_id for r in P.minhash_near_dedup(spark, kept, data).collect()}
    assert one == {r[0] for r in clean}
    lined = {r.doc_id: r.text for r in P.line_dedup(spark, kept, data).collect()}
    assert not set(lined) & {r[0] for r in copies} and all(lined[i] == t for i, t, _, _ in clean)
    mixed = P.mixing_to_targets(spark, docs, data)
    assert mixed.columns == docs.columns and max(mixed.groupBy("doc_id").count().toPandas()["count"]) <= 3
    out = P.sentencepiece_coding(spark, kept, data)
    assert "ids" in out.columns and out.count() == kept.count()


def test_repeated_rows_become_one(spark, make, data):
    rng = random.Random(1)
    text = " ".join(words(rng, 200))
    docs = make([(1, text), (1, text), (2, text), (None, text), (3, None)])
    got = [r.doc_id for r in P.minhash_near_dedup(spark, docs, data).collect()]
    assert sorted(got, key=str) == [1, 3, None]


def test_names_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(catalog.QUERIES) | {"pipeline"} <= set(names)
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing_to_targets", "sentencepiece_coding"]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(1, 40)) and got[201] == got[202] == 200 and 300 not in got
