"""Normal and chi-square tails as column arithmetic, so they stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.text import as_column

# Published rational approximation of erfc with relative error below 1.2e-7.
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)

# Published rational approximation of the normal quantile, relative error 1.15e-9.
QUANTILE_CENTRE_UPPER = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
QUANTILE_CENTRE_LOWER = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
QUANTILE_TAIL_UPPER = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
QUANTILE_TAIL_LOWER = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
QUANTILE_TAIL_START = 0.02425


def _polynomial(x: Column, highest_first) -> Column:
    return reduce(lambda total, a: total * x + F.lit(a), highest_first[1:], F.lit(highest_first[0]))


def erfc(x: Column | str) -> Column:
    x = as_column(x)
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    tail = t * F.exp(-z * z + _polynomial(t, ERFC_COEFFICIENTS[::-1]))
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_cdf(x: Column | str) -> Column:
    return 0.5 * erfc(-as_column(x) / math.sqrt(2.0))


def normal_quantile(p: Column | str) -> Column:
    """Inverse of the normal distribution function; null outside the open unit interval."""
    p = as_column(p)
    q = p - 0.5
    centre = q * _polynomial(q * q, QUANTILE_CENTRE_UPPER) / _polynomial(q * q, QUANTILE_CENTRE_LOWER)

    def tail(prob: Column) -> Column:
        r = F.sqrt(-2.0 * F.log(prob))
        return _polynomial(r, QUANTILE_TAIL_UPPER) / _polynomial(r, QUANTILE_TAIL_LOWER)

    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < QUANTILE_TAIL_START, tail(p))
        .when(p > 1 - QUANTILE_TAIL_START, -tail(1 - p))
        .otherwise(centre)
    )


#: Of more degrees of freedom the terms are summed on the log scale, which big powers and factorials don't overflow.
LONG_SUM = 40


def chi_square_tail(x: Column | str, df: int) -> Column:
    """P(X > x) for a whole number of degrees of freedom, as its finite sum."""
    if df < 1:
        raise ValueError("degrees of freedom must be at least 1")
    half = F.greatest(as_column(x), F.lit(0.0)) / 2.0
    first = 1.0 if df % 2 == 0 else 0.5
    total = F.exp(-half) if df % 2 == 0 else erfc(F.sqrt(half))
    power = first
    # Q(a + 1, h) = Q(a, h) + h^a e^-h / Gamma(a + 1), with a = df / 2
    if df > LONG_SUM:
        steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(math.lgamma(a + 1)).alias("g")) for a in np.arange(first, df / 2).tolist()])
        terms = F.aggregate(steps, F.lit(0.0), lambda t, s: t + F.exp(s["a"] * F.log(half) - half - s["g"]))
        return F.when(half > 0, total + terms).when(half == 0, 1.0)
    while power < df / 2:
        total = total + F.pow(half, F.lit(power)) * F.exp(-half) / math.gamma(power + 1)
        power += 1
    return total
