"""Positions in a total order without sorting everything in one task: values are dealt into ranges by sampled bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def splitters(rows: DataFrame, column: str, ranges: int = 64) -> list[float]:
    """At most ``ranges - 1`` ascending bounds that deal a numeric column into ranges of about equal size."""
    found = rows.approxQuantile(column, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))
    return sorted(set(found))


def range_of(value: Column, bounds: list[float]) -> Column:
    """How many bounds are at most the value, by a tree of comparisons inside the generated code."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def offsets(ranged: DataFrame, before: list[str], within: list[str], ranges: str = "__range") -> DataFrame:
    """Rows ahead of each range: of the same ``within`` group, in order of ``before`` and the range; one row a range."""
    sizes = ranged.groupBy(*within, *before, ranges).agg(F.count(F.lit(1)).alias("__size"))
    line = Window.partitionBy(*within).orderBy(*before, ranges)
    return sizes.withColumn("__ahead", F.sum("__size").over(line) - F.col("__size"))
