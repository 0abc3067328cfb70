"""The registered corpus queries and their reference SQL where SQL can express them."""

from __future__ import annotations

from . import chains, lines, minhash, mixing, pages, pieces, pii, quality, suffixes, vectors

QUERIES = {
    "op1_collinear_chains": chains.op1_collinear_chains,
    "op2_sparse_suffixes": suffixes.op2_sparse_suffixes,
    "op3_html_main_text": pages.op3_html_main_text,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_projection_forest": vectors.op6_projection_forest,
    "op7_pii_spans": pii.op7_pii_spans,
    "op8_sentencepiece_coding": pieces.op8_sentencepiece_coding,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_mixing_to_targets": mixing.op10_mixing_to_targets,
}

ORACLES: dict[str, str] = {
    "op5_minhash_near_dedup": minhash.OP5_SQL,
    "op6_projection_forest": vectors.OP6_SQL,
}
