"""Paired bootstrap comparison of two systems with step-up correction for many comparisons.

Every case gets a Poisson(1) weight per replicate from a hash of its id and the replicate's number, so no case list is ever
resampled or exploded: a task multiplies the weights of its Arrow batches with the differences and keeps two sums per
comparison and replicate. Spark adds up the tasks; a comparison that holds a third of all cases is one row per task and
replicate. The same ids give the same replicates in any engine, partitioning or run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 200
#: fixed odd multipliers of the hash
CASE_STEP, REPLICATE_STEP, STIR = 2654435761, 40503, 2246822519
WORD = 1 << 32


def poisson_limits(most: int = 12) -> list[int]:
    """32-bit limits of the Poisson(1) distribution: a hash below the first is weight 0, below the second weight 1, ..."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])
    return [int(s * WORD) for s in shares]


LIMITS = poisson_limits()


def weights(case: np.ndarray, replicates: int) -> np.ndarray:
    """(cases, replicates) of Poisson(1) weights."""
    word = np.uint64(WORD - 1)
    h = (case.astype(np.uint64)[:, None] * np.uint64(CASE_STEP) + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(REPLICATE_STEP)) & word
    h = ((h ^ (h >> np.uint64(15))) * np.uint64(STIR)) & word
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(CASE_STEP)) & word
    return np.searchsorted(np.array(LIMITS, np.uint64), h ^ (h >> np.uint64(16)), side="right")


def weight_sql(case: str, replicate: str) -> str:
    """The same weight as a SQL expression over unsigned integers (for counterparts in SQL)."""
    h = f"(({case})::UBIGINT * {CASE_STEP} + ({replicate})::UBIGINT * {REPLICATE_STEP}) % {WORD}"
    h = f"((xor({h}, ({h}) >> 15)) * {STIR}) % {WORD}"
    h = f"((xor({h}, ({h}) >> 13)) * {CASE_STEP}) % {WORD}"
    h = f"xor({h}, ({h}) >> 16)"
    return f"len(list_filter({LIMITS}::UBIGINT[], lambda x: x <= {h}))"


def _sums(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for name, s in held.items():
            numbers = pa.array(np.arange(replicates, dtype=np.int32) + 1)
            columns = [pa.array([name] * replicates, pa.string()), numbers, pa.array(s[0]), pa.array(s[1])]
            yield pa.RecordBatch.from_arrays(columns, ["comparison", "replicate", "w", "wd"])

    for batch in batches:
        name = np.array(batch.column(0).to_pylist(), object)
        case, difference = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for k in range(0, len(case), 4096):
            w = weights(case[k : k + 4096], replicates).astype(float)
            for n in set(name[k : k + 4096]):
                own = name[k : k + 4096] == n
                s = held.setdefault(n, np.zeros((2, replicates)))
                s[0] += w[own].sum(axis=0)
                s[1] += difference[k : k + 4096][own] @ w[own]
        if len(held) >= 2000:
            yield from out()
            held.clear()
    yield from out()


def paired_bootstrap(cases: DataFrame, replicates: int = REPLICATES, level: float = 0.95) -> DataFrame:
    """``comparison, n, mean_difference, low, high, p_value, q_value``.

    ``cases(comparison, case_id, a, b)``: scores of two systems on the same cases; ``case_id`` is a non-negative integer. Rows
    with a null are no pair. The interval holds the middle ``level`` of the replicates' weighted means; the p-value is two-sided
    with one added to counts. A replicate whose weights are all 0 is left out. ``q_value`` is Benjamini-Hochberg's.
    """
    pairs = cases.where("comparison IS NOT NULL AND case_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    difference = (F.col("b").cast("double") - F.col("a").cast("double")).alias("difference")
    pairs = pairs.select(F.col("comparison").cast("string").alias("comparison"), F.col("case_id").cast("bigint").alias("case_id"), difference)
    parts = pairs.mapInArrow(lambda b: _sums(b, replicates), "comparison string, replicate int, w double, wd double")
    means = parts.groupBy("comparison", "replicate").agg((F.sum("wd") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    edge = (1 - level) / 2
    sides = F.least(F.count_if(F.col("mean") <= 0), F.count_if(F.col("mean") >= 0))
    spread = means.where("mean IS NOT NULL").groupBy("comparison").agg(
        F.percentile("mean", edge).alias("low"),
        F.percentile("mean", 1 - edge).alias("high"),
        F.least(F.lit(1.0), 2 * (sides + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )
    observed = pairs.groupBy("comparison").agg(F.count(F.lit(1)).alias("n"), F.avg("difference").alias("mean_difference"))
    return step_up(observed.join(spread, "comparison", "left"), "p_value", "q_value")


def step_up(tests: DataFrame, p: str, name: str) -> DataFrame:
    """Adds Benjamini-Hochberg's adjusted p-values: one row per comparison, so the window over all rows is as small as the report.

    Equal p-values share the largest of their ranks; tests without a p-value are not counted.
    """
    # the least of p * m / rank over this p-value and all larger ones; equal values belong to one frame
    upwards = Window.orderBy(F.col(p).asc_nulls_last())
    counted = tests.withColumns({"_m": F.count(p).over(Window.partitionBy()), "_rank": F.count(p).over(upwards)})
    raw = F.col(p) * F.col("_m") / F.col("_rank")
    behind = Window.orderBy(F.col(p).desc_nulls_first())
    adjusted = F.least(F.lit(1.0), F.min(raw).over(behind))
    return counted.withColumn(name, F.when(F.col(p).isNotNull(), adjusted)).drop("_m", "_rank")
