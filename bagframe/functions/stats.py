"""Aggregate expressions and p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column | int | float, b: Column) -> Column:
    """a / b as DOUBLE, NULL when b is 0."""
    a = a if isinstance(a, Column) else F.lit(a)
    return F.try_divide(a.cast("double"), b.cast("double"))


def entropy(x: str | Column, normalized: bool = True) -> Column:
    """Aggregate: Shannon entropy of x / sum(x) in nats, divided by ln(count). From sums only, zero counts as 0."""
    c = F.col(x) if isinstance(x, str) else x
    c = c.cast("double")
    total = F.sum(c)
    xlogx = F.sum(F.when(c > 0, c * F.log(c)).otherwise(F.when(c == 0, F.lit(0.0))))
    h = F.log(total) - ratio(xlogx, total)
    return ratio(h, F.log(F.count(c).cast("double"))) if normalized else h


def hoyer(x: str | Column) -> Column:
    """Aggregate: Hoyer sparseness, 0 for uniform values and 1 for a single non-zero value."""
    c = F.col(x) if isinstance(x, str) else x
    c = c.cast("double")
    root = F.sqrt(F.count(c).cast("double"))
    return ratio(root - ratio(F.sum(F.abs(c)), F.sqrt(F.sum(c * c))), root - 1)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def chi2_sf(stat: float, dof: int) -> float:
    """Upper tail of the chi-square distribution."""
    if stat != stat:
        return float("nan")
    if dof <= 0:
        return 1.0
    return math.erfc(math.sqrt(stat / 2)) if dof == 1 else _upper_gamma(dof / 2, stat / 2)


_SERIES = [(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(45)]


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: the power series below 2, the continued fraction from 2 on."""
    near = F.aggregate(F.array(*[F.lit(c) for c in reversed(_SERIES)]), F.lit(0.0), lambda s, c: s * z * z + c) * z * (2 / math.sqrt(math.pi))
    far = F.aggregate(F.array(*[F.lit(k / 2) for k in range(80, 0, -1)]), z, lambda s, k: z + k / s)
    return F.when(z < 2, 1 - near).otherwise(F.exp(-z * z) / (far * math.sqrt(math.pi)))


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution with no or one degree of freedom. NULL statistic gives NULL."""
    many = F.raise_error(F.lit("only 0 or 1 degrees of freedom")).cast("double")
    return F.when(stat.isNull() | dof.isNull(), F.lit(None).cast("double")).when(dof <= 0, 1.0).when(dof == 1, erfc(F.sqrt(stat.cast("double") / 2))).otherwise(many)
