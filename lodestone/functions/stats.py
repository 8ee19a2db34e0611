"""Estimators as column functions; five quantile conventions, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95, Z_EXACT, Z_POWER80 = 1.96, 1.959964, 0.841621


def wilson(x: Column, n: Column, z: float = Z95) -> Column:
    """``struct(lo, hi)``; of nothing: (0, 1)."""
    p, zz = F.try_divide(x, n), z * z
    mid = F.try_divide(p + F.try_divide(F.lit(zz), 2 * n), 1 + F.try_divide(F.lit(zz), n))
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(zz), 4 * n * n)), 1 + F.try_divide(F.lit(zz), n))
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)).alias("lo"), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0)).alias("hi"))


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """``struct(d, lo, hi)`` of a difference of two rates, from two Wilson intervals."""
    a, b = wilson(x1, n1), wilson(x2, n2)
    p, q = F.try_divide(x1, n1), F.try_divide(x2, n2)
    d = p - q
    lo = d - F.sqrt((p - a["lo"]) * (p - a["lo"]) + (b["hi"] - q) * (b["hi"] - q))
    hi = d + F.sqrt((a["hi"] - p) * (a["hi"] - p) + (q - b["lo"]) * (q - b["lo"]))
    return F.struct(d.alias("d"), lo.alias("lo"), hi.alias("hi"))


def ratio_product(top: Column, bottom: Column, k: Column) -> Column:
    """Product of ``(top - i) / (bottom - i)`` for i below k; zero if top runs out."""
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(1.0), lambda p, i: p * F.greatest(top - i, F.lit(0)) / (bottom - i))).otherwise(F.lit(1.0))


def pass_at(n: Column, c: Column, k: Column) -> Column:
    return F.when(k <= n, 1 - ratio_product(n - c, n, k))


def pass_hat(n: Column, c: Column, k: Column) -> Column:
    return F.when(k <= n, ratio_product(c, n, k))


def mde(p: Column, n1: Column, n2: Column) -> Column:
    """Least difference that 80 % power detects."""
    return (Z_EXACT + Z_POWER80) * F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))


# Of a sorted array without nulls:
def _at(xs: Column, i: Column) -> Column:
    return F.when(F.size(xs) > 0, F.get(xs, i.cast("int")))


def upper_median(xs: Column) -> Column:
    return _at(xs, F.floor(F.size(xs) / 2))


def floor_quantile(xs: Column, f: float) -> Column:
    """At ``int(f * (n - 1))``."""
    return _at(xs, F.floor(F.lit(f) * (F.size(xs) - 1)))


def clipped_quantile(xs: Column, p: float) -> Column:
    """At ``min(n - 1, int(p * n))``."""
    return _at(xs, F.least(F.size(xs) - 1, F.floor(F.lit(p) * F.size(xs)).cast("int")))


def rule_of_three(n: Column) -> Column:
    """Upper bound, in per cent, of a share of which ``n`` trials showed none."""
    return F.try_divide(F.lit(300.0), n)


def looked_at(rejected: Column, n: Column, k: Column) -> Column:
    """How many of the first ``k`` places, in a random order of ``n`` draws, a draw may take with only ``rejected`` others
    before it, each place weighed by its chance; ``n`` times the chance that best-of-k looks at it."""
    places = F.sequence(F.lit(0), F.least(k, n).cast("int") - 1)
    return F.aggregate(places, F.lit(0.0), lambda total, before: total + ratio_product(rejected, n - 1, before))


def kept_chance(n: Column, rejected: Column, k: Column) -> Column:
    """The chance that an accepted draw is the one that best-of-k keeps."""
    return looked_at(rejected, n, k) / n
