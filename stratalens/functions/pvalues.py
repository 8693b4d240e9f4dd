"""Two-sided p-value of the signed-rank statistic, the one place that needs Python numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

EXACT_LIMIT = 50


def _exact(w: float, n: int) -> float:
    """Share of the 2**n sign patterns at least as extreme: subset sums of 1..n, counted."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for r in range(1, n + 1):
        counts[r:] = counts[r:] + counts[:-r]
    low = counts[: int(math.floor(w)) + 1].sum() / 2.0**n
    return min(1.0, 2.0 * low)


def _normal(w: float, n: int, tie_term: float) -> float:
    spread = (n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24.0
    if spread <= 0:
        return math.nan
    z = (w - n * (n + 1) / 4.0) / math.sqrt(spread)
    return math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_p(method: str = "auto"):
    """Column function of (smaller rank sum, pairs, tie term). ``method``: auto, exact or normal."""
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method: {method}")

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for a, b, t in zip(w, n, ties):
            if b is None or not b >= 1:
                out.append(None)
                continue
            exact = method == "exact" or (method == "auto" and b <= EXACT_LIMIT and t == 0)
            value = _exact(a, int(b)) if exact else _normal(a, int(b), t)
            out.append(None if math.isnan(value) else value)
        return pd.Series(out, dtype="float64")

    return p
