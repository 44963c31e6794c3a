"""Dealing rows to ranges of a whole-number key whose bounds are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def above(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the key: a search by halving over one constant array, so that
    neither the plan nor the work on a row grows with the bounds (but for their logarithm)."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))


def bounds(df: DataFrame, key: Column, n: int) -> list[int]:
    """Bounds of n ranges of about as many rows each; the driver gets n numbers at most."""
    if n <= 1:
        return []
    cut = df.select(key.cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
    return sorted({int(x) for x in cut})
