"""Ordered work over groups of any size.

A window over a whole session would put a session that holds a third of all
rows into one task. These helpers cut every group into fixed order segments,
work inside the segments, and combine the (far fewer) segment totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096


def segment_of(order: Column, size: int = SEGMENT) -> Column:
    return F.floor(order / F.lit(size)).cast("bigint")


def running_before(
    df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, size: int = SEGMENT
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the group (0 for the first)."""
    work = df.withColumn("_seg", segment_of(F.col(order), size)).withColumn("_value", value)
    totals = work.groupBy(*keys, "_seg").agg(F.sum("_value").alias("_total"))
    upto = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_seg", F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_seg").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        work.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_seg"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_seg", "_value", "_inside", "_offset")
    )


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "recency") -> DataFrame:
    """The first ``n`` rows per group in the given order; the limit also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
