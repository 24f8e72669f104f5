"""Upper tail of the chi-square distribution in built-in functions.

With h = x / 2 the tail is a finite sum for every whole number of degrees of
freedom: Poisson terms for even ones, erfc(sqrt(h)) plus half-integer terms for
odd ones. Terms are kept as logarithms, so large statistics do not overflow.
"""

from __future__ import annotations

STEPS = 80  # terms of the erfc expansions, past double precision on both branches
SWITCH = 4.0  # h from which the continued fraction converges faster


def erfc_sqrt(h: str) -> str:
    """SQL for erfc(sqrt(h)), h > 0: a series of positive terms or a continued fraction."""
    series = (
        f"aggregate(sequence(1, {STEPS}), named_struct('term', sqrt({h}), 'total', sqrt({h})),"
        f" (acc, n) -> named_struct('term', acc.term * 2 * {h} / (2 * n + 1),"
        f" 'total', acc.total + acc.term * 2 * {h} / (2 * n + 1)),"
        f" acc -> 1 - 2 / sqrt(pi()) * exp(-{h}) * acc.total)"
    )
    fraction = (
        f"aggregate(sequence({STEPS}, 1), 1D, (acc, n) -> 1 + n / (2 * {h}) / acc,"
        f" acc -> exp(-{h}) / sqrt({h} * pi()) / acc)"
    )
    return f"CASE WHEN {h} < {SWITCH} THEN {series} ELSE {fraction} END"


def chi2_tail(statistic: str, dof: str) -> str:
    """SQL for P(X >= statistic); NULL when either input is NULL or dof < 1."""
    h = f"(CAST({statistic} AS DOUBLE) / 2)"
    odd = f"({dof} % 2 = 1)"
    count = f"CAST(({dof} - 1) DIV 2 AS INT)"
    positions = f"CASE WHEN {count} > 0 THEN sequence(1, {count}) ELSE CAST(array() AS ARRAY<INT>) END"
    log_first = f"CASE WHEN {odd} THEN -{h} - ln({h}) / 2 - ln(pi()) / 2 ELSE -{h} END"
    first_sum = f"CASE WHEN {odd} THEN {erfc_sqrt(h)} ELSE exp(-{h}) END"
    log_next = f"acc.log_term + ln({h}) - ln(j - CASE WHEN {odd} THEN 0.5D ELSE 0D END)"
    tail = (
        f"aggregate({positions}, named_struct('log_term', {log_first}, 'total', {first_sum}),"
        f" (acc, j) -> named_struct('log_term', {log_next}, 'total', acc.total + exp({log_next})),"
        f" acc -> CASE WHEN acc.total > 1 THEN 1D ELSE acc.total END)"
    )
    return f"CASE WHEN {dof} >= 1 THEN CASE WHEN {h} <= 0 THEN 1D ELSE {tail} END END"
