"""Every operator on the edge-case table and on an empty one."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import chains, lines, minhash, mixing, pages, pieces, pii, quality, suffixes, vectors

DOCUMENTS = {
    "chains": chains.fuzzy_passages,
    "suffixes": suffixes.repeated_passages,
    "quality": quality.quality,
    "minhash": minhash.near_duplicates,
    "pii": pii.find_pii,
    "pieces": lambda d: pieces.encoded(d, check=True),
    "lines": lines.without_duplicate_lines,
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_edge_rows(edge, name):
    rows = DOCUMENTS[name](edge).collect()
    if name in ("chains", "suffixes"):
        # Document 10 repeats its own words, which only the suffix array reports.
        assert {r.doc_id for r in rows} - {10} == {6, 7, 8}
        assert all(r.component_id == (6 if r.doc_id < 10 else 10) for r in rows)
    else:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in edge.collect())
    by = {r.doc_id: r for r in rows}
    if name == "minhash":
        assert {i for i, r in by.items() if not r.kept} == {7, 8} and by[7].component_id == by[8].component_id == 6
        assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1
        assert by[None].component_id is None and by[None].kept
    if name == "quality":
        assert all(by[i].base_failed and not by[i].kept for i in (1, 2, 3, 4)) and by[1].n_words == 0
    if name == "lines":
        assert by[1].text is None and by[6].n_dropped == 0 and by[7].text == by[8].text == "" and by[None].n_dropped == 0
    if name == "pieces":
        assert by[1].ids == [] and by[2].ids == [] and all(r.round_trip for r in rows)
        assert by[5].h == 1
    if name == "mixing":
        assert all(0 <= r.taken <= 3 * r.size for r in rows) and by[2].taken == 0


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_empty_table(make, name):
    assert DOCUMENTS[name](make([])).collect() == []


def test_pages_edges(spark):
    rows = [(1, None, None, "a"), (2, "http://h/1", "", "a"), (3, "::bad[", "<p>x", "a"), (3, "::bad[", "<p>x", "a"), (None, "http://h/2", "<b>" * 3000 + "deep", "a"), (5, "http://h/3", "text only &lt; &amp &#233; <a hre", "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = pages.main_text(df).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[3].text == "x" and by[None].text == "deep"
    assert by[5].text == "text only < & é"
    assert pages.main_text(df.where(F.lit(False))).collect() == []


def test_vectors_edges(spark):
    one, nan, inf = [1.0, 2.0], [float("nan"), 1.0], [float("inf"), 1.0]
    rows = [(1, one), (2, one), (2, one), (3, None), (4, []), (5, [0.0, 0.0]), (6, nan), (7, inf), (8, [1.0, None]), (None, one), (9, [1.0, 2.0, 3.0]), (10, [2.0, 4.0]), (11, [-1.0, -2.0])]
    got = vectors.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[1].n_links == by[2].n_links == by[10].n_links == 3 and by[10].component_id == 1
    assert all(by[i].n_links == 0 and by[i].kept and by[i].component_id == i for i in (3, 4, 5, 6, 7, 8, 9, 11))
    assert by[None].component_id is None and by[None].kept
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
