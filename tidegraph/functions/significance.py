"""Two-sided p-value of a correlation coefficient."""

from __future__ import annotations

from math import lgamma, pi

import numpy as np
from pyspark.sql import Column, functions as F

TAIL_FROM = 0.1
TAIL_TERMS = 400


def _tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function of one value, by its continued fraction; the series below must agree with it."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _tail(1.0 - x, b, a)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    c, value = 1.0, d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return float(front * value)


def correlation_p(r: str | Column, n: str | Column) -> Column:
    """p of (r, n) under Student's t with n-2 degrees of freedom, as a column expression; null for a null r or n below 3.

    For whole degrees of freedom the distribution is a finite series in the cosine of the angle whose sine is abs(r), and p is what
    follows in the infinite one. From r² = 0.1 on the latter is summed (its terms fall by at least that share, so 400 reach double
    precision, also of tiny p); below, p is one less the finite series, to about 1e-15.
    """
    r, n = (F.col(x) if isinstance(x, str) else x for x in (r, n))
    size, freedom = F.least(F.abs(r.cast("double")), F.lit(1.0)), n.cast("long") - 2
    cosine2 = 1 - size * size
    odd = freedom % 2 == 1

    def added(state: Column, e: Column) -> Column:
        return F.struct((state["total"] + state["term"]).alias("total"), (state["term"] * (e + 1) / (e + 2) * cosine2).alias("term"))

    start = F.struct(F.lit(0.0).alias("total"), F.when(odd, F.sqrt(cosine2) * (2 / pi)).otherwise(1.0).alias("term"))
    steps = F.when(freedom > 1, F.sequence(freedom % 2, freedom - 2, F.lit(2).cast("long"))).otherwise(F.array().cast("array<long>"))
    finite = F.aggregate(steps, start, added)
    beyond = F.struct(F.lit(0.0).alias("total"), finite["term"].alias("term"))
    tail = F.aggregate(F.sequence(freedom, freedom + 2 * (TAIL_TERMS - 1), F.lit(2).cast("long")), beyond, added)["total"] * size
    rest = F.greatest(F.lit(0.0), 1 - F.when(odd, F.asin(size) * (2 / pi)).otherwise(0.0) - finite["total"] * size)
    known = r.isNotNull() & ~F.isnan(r.cast("double")) & (freedom >= 1)
    return F.when(known, F.when(size * size >= TAIL_FROM, F.least(tail, F.lit(1.0))).otherwise(rest))
