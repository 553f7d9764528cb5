"""Small statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % point of the normal distribution.
Z = 1.959964


def wilson(x: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high): the Wilson interval of x successes in n, within 0 and 1; null when n is 0."""
    p = F.when(n > 0, x / n)
    zz = z * z
    centre = (p + F.lit(zz) / (2 * n)) / (1 + F.lit(zz) / n)
    half = z * F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n)) / (1 + F.lit(zz) / n)
    both = F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))
    return F.when(n > 0, both)


def t_stat(x: Column) -> Column:
    """Mean over its standard error (an aggregate); null for fewer than 2 values or no spread."""
    n, var = F.count(x), F.var_samp(x)
    return F.when((n >= 2) & (var > 0), F.avg(x) / F.sqrt(var / n))


def int_median(x: Column) -> Column:
    """Median of non-negative integers, cut to an integer (an aggregate)."""
    return F.floor(F.percentile(x, F.lit(0.5))).cast("long")


def tri(known_true: Column, known_false: Column) -> Column:
    """A verdict from what is known: true, false or null."""
    return F.when(known_true, True).when(known_false, False)
