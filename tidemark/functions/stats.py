"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = F.when(z < 0, -1.0).otherwise(1.0) * (1 - poly * F.exp(-x * x))
    return 0.5 * (1 + erf)


def one_sided_p(z: Column) -> Column:
    """Upper tail, clamped to [0, 1]; a z that is no finite number gives 1."""
    finite = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - normal_cdf(z)))).otherwise(1.0)


def pocock_spent(fraction: Column, alpha: float) -> Column:
    return alpha * F.ln(1 + (math.e - 1) * fraction)


def spent_alpha(look: Column, alpha: float = 0.05) -> Column:
    """Alpha for a look: all of it for the first, then the increments of the Pocock curve between looks."""
    return F.when(look <= 1, F.lit(alpha)).otherwise(pocock_spent(F.lit(1.0), alpha) - pocock_spent((look - 1) / look, alpha))


def spent_alpha_py(look: int, alpha: float = 0.05) -> float:
    spent = lambda f: alpha * math.log(1 + (math.e - 1) * f)
    return alpha if look <= 1 else spent(1.0) - spent((look - 1) / look)


def hac_lag(n: Column, lookback: int) -> Column:
    """floor(cbrt n) within [1, lookback - 1], by whole numbers; 0 for n < 2."""
    near = F.floor(F.cbrt(n.cast("double")) + 0.5).cast("long")
    root = F.when(near * near * near <= n, near).otherwise(near - 1)
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(F.least(F.lit(max(0, lookback - 1)).cast("long"), F.greatest(F.lit(1).cast("long"), root)))
