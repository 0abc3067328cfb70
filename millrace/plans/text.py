"""Plain-text reports of contexts, worker resolution, advisories, verdicts, costs and estimates."""

from __future__ import annotations

from typing import Any

LABELS = {"safe": "SAFE TO RUN", "safe_with_warnings": "SAFE TO RUN, with the warnings above", "not_recommended": "NOT RECOMMENDED"}
#: The order in which reasons for low confidence are shown.
REASONS = ["fallback_used", "sparse_evidence", "weak_match", "high_variance", "dominant_match"]


def context(values: dict[str, Any]) -> str:
    return "\n".join(f"{k.replace('_', ' ')}: {v}" for k, v in values.items()) or "no context declared"


def waterfall(row: dict[str, Any]) -> str:
    """One line for each stage that a worker count went through."""
    return f"base {row['base']} -> caps {row['after_caps']} -> factor {row['factor']:.2f}: {row['after_factors']} -> {row['workers']} workers"


def advisories(found: list[dict[str, Any]]) -> str:
    return "\n".join(f"[{a['severity'].upper()}] {a['field'].replace('_', ' ')}" for a in found)


def verdict(value: str) -> str:
    return LABELS[value]


def duration(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f} s"
    return f"{seconds / 60:.1f} min" if seconds < 3600 else f"{seconds / 3600:.1f} h"


def costs(options: list[dict[str, Any]], currency: str = "USD") -> str:
    return "\n".join(f"{o['workers']} workers: {duration(o['seconds'])}, {o['total']:.4f} {currency}" + (" (planned)" if o["is_planned"] else "") for o in options)


def reasons(n: int, best: float, cv: float | None, dominant: bool, fallback: bool = False) -> list[str]:
    """Why an estimate's confidence is what it is, in the order to show them."""
    hit = {"fallback_used": fallback, "sparse_evidence": n == 1 or (fallback and n == 0), "weak_match": n >= 1 and best < 0.65, "high_variance": cv is not None and cv > 0.2, "dominant_match": dominant}
    return [r for r in REASONS if hit[r]]


def exclusions(left_out: list[tuple[str, str]], shown: int = 3) -> str:
    lines = [f"{run}: {why}" for run, why in left_out[:shown]]
    return "\n".join(lines + ([f"and {len(left_out) - shown} more"] if len(left_out) > shown else []))


def estimate(row: dict[str, Any]) -> str:
    return f"{row['value']:,.0f} rows/s ({row['method']}, {row['confidence']} confidence, {row['n_matched']} matching runs)"
