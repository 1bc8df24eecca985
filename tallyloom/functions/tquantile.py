"""Student-t quantiles as an expression of the degrees of freedom.

Up to ``EXACT_DF`` the quantile is looked up in a short literal array, which is
filled when the expression is built; above it the asymptotic expansion in 1/df
is exact to better than 1e-8.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

EXACT_DF = 100


def _t_cdf(t: float, df: int) -> float:
    """CDF of Student's t for whole df, by its finite trigonometric sum."""
    theta = math.atan2(t, math.sqrt(df))
    c2 = math.cos(theta) ** 2
    total = 0.0
    if df % 2:
        term = math.cos(theta)
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c2 * (2 * k) / (2 * k + 1)
        area = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        term = 1.0
        for k in range(1, df // 2 + 1):
            total += term
            term *= c2 * (2 * k - 1) / (2 * k)
        area = math.sin(theta) * total
    return 0.5 + area / 2


@lru_cache(maxsize=None)
def exact_quantiles(p: float) -> tuple[float, ...]:
    """Quantiles at probability ``p`` for df = 1 .. EXACT_DF."""
    out = []
    for df in range(1, EXACT_DF + 1):
        lo, hi = -1e6, 1e6
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _t_cdf(mid, df) < p else (lo, mid)
        out.append((lo + hi) / 2)
    return tuple(out)


@lru_cache(maxsize=None)
def t_quantile(df: str, p: float = 0.975) -> str:
    """Quantile at ``p`` for ``df`` degrees of freedom; NULL where df < 1."""
    q = NormalDist().inv_cdf(p)
    terms = [
        (q**3 + q) / 4,
        (5 * q**5 + 16 * q**3 + 3 * q) / 96,
        (3 * q**7 + 19 * q**5 + 17 * q**3 - 15 * q) / 384,
    ]
    series = " + ".join(
        [f"{q!r}D"] + [f"{c!r}D / power({df}, {i})" for i, c in enumerate(terms, start=1)]
    )
    table = ", ".join(f"{x!r}D" for x in exact_quantiles(p))
    small = f"get(array({table}), CAST({df} - 1 AS INT))"
    return f"CASE WHEN {df} > {EXACT_DF} THEN {series} WHEN {df} >= 1 THEN {small} END"
