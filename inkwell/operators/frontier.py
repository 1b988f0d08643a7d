"""Costs of tasks, the quality-cost frontier and the area below it.

The frontier is a skyline: a point stays if no point of the same or a lower cost has at least its quality. Points are
range-partitioned by (group, cost, quality): a first pass takes the best quality of every (group, range), a running maximum over
these few rows gives each range what lies before it, and a second pass takes running maxima inside the ranges. A
group that holds a third of all points is spread over many ranges and no window holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialized


def cost_rollup(runs: DataFrame, keys: list[str], cost: Column, good: Column) -> DataFrame:
    """``*keys, n_runs, cost, quality, cost_per_good``: total cost, share of good runs and cost of each; map-side combined."""
    right = F.count_if(good)
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"),
        (right / F.count(F.lit(1))).alias("quality"),
        F.try_divide(F.coalesce(F.sum(cost), F.lit(0.0)), right).alias("cost_per_good"),
    )


def frontier(points: DataFrame, group: str, point: str) -> DataFrame:
    """``group, point, cost, quality`` of the points that no other point dominates.

    ``points`` has the group and point columns, cost and quality. Of equal points the smallest ``point`` stays. Points with a null cost
    or quality are left out; null groups form one.
    """
    usable = points.select(group, point, "cost", "quality").where("cost IS NOT NULL AND quality IS NOT NULL")
    order = [F.col(group).asc_nulls_first(), F.col("cost"), F.col("quality").desc(), F.col(point)]
    ranges = usable.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges = materialized(ranges, "frontier-points")  # the numbers of the ranges follow the order of the points
    best = ranges.groupBy(group, "_range").agg(F.max("quality").alias("_best"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = best.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.max("_best").over(earlier).alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy("cost", F.col("quality").desc(), point).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("quality").over(inside), F.col("_before"))
    joined = ranges.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_seen", seen).where("_seen IS NULL OR quality > _seen").select(group, point, "cost", "quality")


def quality_cost_area(points: DataFrame, group: str, point: str) -> DataFrame:
    """``group, n_frontier, least_cost, most_cost, area``: trapezoids under the frontier, as a share of the cost span.

    A frontier of one point, or without a span of cost, has the area of its best quality.
    """
    front = frontier(points, group, point)
    step = Window.partitionBy(group).orderBy("cost")  # quality rises along a frontier, so it has few points
    last_cost, last_quality = F.lag("cost").over(step), F.lag("quality").over(step)
    slices = front.withColumn("_slice", (F.col("cost") - last_cost) * (F.col("quality") + last_quality) / 2)
    span = F.max("cost") - F.min("cost")
    return slices.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_frontier"), F.min("cost").alias("least_cost"), F.max("cost").alias("most_cost"),
        F.when(span > 0, F.sum("_slice") / span).otherwise(F.max("quality")).alias("area"),
    )
