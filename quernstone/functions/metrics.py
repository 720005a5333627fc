"""The pass@k family as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 if fewer than k of n failed, else 1 - prod(1 - k / i) for i from n-c+1 to n; NaN if n = 0 or c > n.

    ``sequence`` counts down where a range would be empty, so c = 0 is apart.
    """
    product = F.aggregate(
        F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i.cast("double"))
    )
    return (
        F.when((n == 0) | (c > n), F.lit(float("nan")))
        .when(n - c < k, F.lit(1.0))
        .when(c == 0, F.lit(0.0))
        .otherwise(F.lit(1.0) - product)
    )


def pass_at_ks(n: Column, c: Column, ks: tuple[int, ...]) -> Column:
    """pass@k for several k as an array, in one pass over the factors.

    The factors are made from c, the number of those that passed, so that what
    a row costs follows c and not n times the number of k.
    """
    start = F.array(*[F.lit(1.0) for _ in ks])
    share = F.array(*[F.lit(float(k)) for k in ks])
    product = F.aggregate(F.sequence(n - c + 1, n), start, lambda acc, i: F.zip_with(acc, share, lambda a, k: a * (F.lit(1.0) - k / i.cast("double"))))
    some = (c > 0) & (c <= n) & (n > 0)
    product = F.when(some, product)
    values = []
    for at, k in enumerate(ks):
        value = F.when((n == 0) | (c > n), F.lit(float("nan"))).when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0))
        values.append(value.otherwise(F.lit(1.0) - product[at]))
    return F.array(*values)


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage; NaN of nothing."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(F.lit(100.0) * part / F.nullif(whole, F.lit(0)))
