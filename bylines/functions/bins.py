"""Half-open bins."""

from __future__ import annotations

from collections.abc import Sequence

from bylines.functions import sql

# Lower edges, and the upper bound shown for the closed last bin.
EDGES = (1, 2, 3, 4, 5, 6, 7, 8)
TOP = 14


def bin_labels(edges: Sequence[float] = EDGES, top: float = TOP) -> list[str]:
    inner = [f"[{low},{high})" for low, high in zip(edges, edges[1:], strict=False)]
    return [*inner, f"[{edges[-1]},{top}]"]


def bin_of(value: str, edges: Sequence[float] = EDGES, labels: Sequence[str] | None = None) -> str:
    """SQL for the label of a value's bin; NULL below the first edge, open above the last."""
    bins = reversed(list(zip(edges, labels or bin_labels(edges), strict=True)))
    cases = " ".join(f"WHEN {value} >= {edge} THEN {sql.literal(label)}" for edge, label in bins)
    return f"CASE {cases} END"
