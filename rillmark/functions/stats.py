"""Exact order statistics that scale: no task ever holds all values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Values are first counted in cells of 2**17 (131 seconds, for milliseconds).
CELL_BITS = 17


def value_counts(df: DataFrame, keys: list[str], value: str, **more: Column) -> DataFrame:
    """``keys, cell, value, n``: counts of equal values, combined before the shuffle; ``more`` are further aggregates."""
    aggregates = [F.count("*").alias("n"), *(c.alias(name) for name, c in more.items())]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.shiftright(value, CELL_BITS).alias("cell"), F.col(value).alias("value")).agg(*aggregates)


def upper_median(counts: DataFrame, keys: list[str], totals: tuple[str, ...] = ()) -> DataFrame:
    """``keys, n, median`` from :func:`value_counts`; the median is the sorted element at index n // 2.

    Cells are counted first and the cell that holds the rank is searched alone, so the largest
    window is the number of cells or the width of one of them, not the number of values.
    ``totals`` names further aggregates, which come out added up.
    """
    cells = counts.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in totals])
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = own.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(own)).withColumn("rank", F.floor(F.col("total") / 2))
    for t in totals:
        placed = placed.withColumn(t, F.sum(t).over(own))
    names = [f"_key{i}" for i in range(len(keys))]
    hit = placed.where("upto > rank and upto - n <= rank").select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("cell").alias("_cell"), "total", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rest"),
        *[F.col(t).alias(f"_total_{t}") for t in totals],
    )
    # Both uses of the counts must read the same columns and filters, or their exchange is made twice: hence the
    # comparison of cells that are never null, and of shares that are never above their totals.
    condition = F.col("cell").eqNullSafe(F.col("_cell"))
    for k, n in zip(keys, names, strict=True):
        condition = condition & F.col(k).eqNullSafe(F.col(n))
    for t in totals:
        condition = condition & (F.coalesce(F.col(t), F.lit(0)) <= F.col(f"_total_{t}"))
    inside = counts.join(hit, condition).select(*keys, "value", "n", "total", "rest", *[F.col(f"_total_{t}").alias(t) for t in totals])
    at = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("upto", F.sum("n").over(at)).where("upto > rest and upto - n <= rest")
    return found.select(*keys, F.col("total").alias("n"), F.col("value").alias("median"), *totals)
