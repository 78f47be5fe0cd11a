"""Numbers that need a special function: computed with the standard library, or in pandas UDFs over small result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import importable


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_pmf(n: int, k: int, p: float) -> float:
    if k < 0 or k > n:
        return 0.0
    if p in (0.0, 1.0):
        return float(k == (n if p else 0))
    return math.exp(log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_tail(n: int, x: int, p: float) -> float:
    """P(X >= x).

    Terms are followed from the largest one on by their ratios.  Those so far away that by Bernstein's bound all of
    them together are less than 3e-20 of it, under a thousandth of the sum's rounding, are left out; so the work grows with the root of n.
    """
    if x <= 0:
        return 1.0
    if x > n or p in (0.0, 1.0):
        return float(x <= n and p == 1.0)
    top = min(n, max(x, int((n + 1) * p)))
    c = math.log(n + 2) + 45
    far = int(c / 3 + math.sqrt(c * c / 9 + 2 * c * n * p * (1 - p))) + 2
    odds = math.log(p) - math.log1p(-p)
    up, down = np.arange(top, min(n, top + far), dtype=np.float64), np.arange(top, max(x, top - far), -1, dtype=np.float64)
    rising = np.exp(np.cumsum(np.log((n - up) / (up + 1)) + odds))
    falling = np.exp(np.cumsum(np.log(down / (n - down + 1)) - odds))
    return min(1.0, binomial_pmf(n, top, p) * math.fsum((1.0, *rising.tolist(), *falling.tolist())))


def binomial_cdf(n: int, x: int, p: float) -> float:
    return max(0.0, 1 - binomial_tail(n, x + 1, p))


def binomial_quantile(n: int, p: float, q: float) -> int:
    total = 0.0
    for k in range(n + 1):
        total += binomial_pmf(n, k, p)
        if total >= q:
            return k
    return n


def clopper_pearson(n: int, x: int, alpha: float = 0.05) -> tuple[float, float]:
    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    lower = 0.0 if x == 0 else solve(lambda p: binomial_tail(n, x, p) < alpha / 2)
    upper = 1.0 if x == n else solve(lambda p: binomial_cdf(n, x, p) > alpha / 2)
    return lower, upper


def mcnemar(b: int, c: int, least: int = 6) -> float | None:
    """Two-sided exact p of the discordant pairs; None below ``least`` of them."""
    return None if b + c < least else min(1.0, 2 * binomial_cdf(b + c, min(b, c), 0.5))


def exact_tail(n: Column, x: Column, p: float) -> Column:
    importable()

    @F.pandas_udf("double")
    def tail(n: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), p) for a, b in zip(n, x)])

    return tail(n, x)


def interval(n: Column, x: Column, alpha: float = 0.05) -> Column:
    importable()

    @F.pandas_udf("low double, high double")
    def bounds(n: pd.Series, x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), alpha) for a, b in zip(n, x)], columns=["low", "high"])

    return bounds(n, x)


def mcnemar_p(b: Column, c: Column, least: int = 6) -> Column:
    importable()

    @F.pandas_udf("double")
    def p(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([mcnemar(int(x), int(y), least) for x, y in zip(b, c)], dtype="float64")

    return p(b, c)


def quantile(n: Column, p: float, q: Column) -> Column:
    importable()

    @F.pandas_udf("bigint")
    def least(n: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([binomial_quantile(int(a), p, float(b)) for a, b in zip(n, q)])

    return least(n, q)
