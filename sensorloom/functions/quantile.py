"""Quantiles from cumulative histogram buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_quantile(bounds: list[float], cumulative: list[Column], total: Column, q: float) -> Column:
    """Linear interpolation inside the first bucket that reaches the rank.

    ``cumulative[i]`` counts values ``<= bounds[i]``. Beyond the last bound the result
    is that bound; with no values it is null.
    """
    rank = total * F.lit(q)
    result = F.when(total == 0, F.lit(None).cast("double"))
    lower, below = 0.0, F.lit(0)
    for upper, count in zip(bounds, cumulative):
        inside = F.lit(lower) + F.lit(upper - lower) * ((rank - below) / F.nullif(count - below, F.lit(0)))
        result = result.when(count >= rank, inside)
        lower, below = upper, count
    return result.otherwise(F.lit(bounds[-1]))
