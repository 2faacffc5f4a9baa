"""Expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def deviations(n: Column, sums: Column, squares: Column) -> Column:
    """Standard deviations by dimension from a cluster's count, sums and sums of squares."""
    return F.zip_with(sums, squares, lambda s, q: F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))))


def normalised_distance(x: Column, centre: Column, deviation: Column) -> Column:
    """Distance in units of the standard deviation; dimensions without deviation are left out."""
    return F.sqrt(total(F.zip_with(F.zip_with(x, centre, lambda a, b: a - b), deviation, lambda d, s: F.when(s > 0, (d / s) * (d / s)).otherwise(F.lit(0.0)))))
