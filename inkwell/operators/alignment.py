"""Supervised and preference records from labelled tool cases, with stratified splits.

``cases(case_id, category, user_query, thought, action, arguments, rejected_action,
rejected_arguments, rejected_thought)``; arguments are JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Leading hexadecimal digits that cut the hash order into ranges: 16 per digit.
RANGE_DIGITS = 3


def eval_size(n: Column, train_ratio: float) -> Column:
    """Half-even rounding, at least one, and at least one row left for training."""
    return F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(1.0 - train_ratio)).cast("bigint")))


def stratified_split(cases: DataFrame, stratum: str = "action", key: str = "case_id", seed: int = 42, train_ratio: float = 0.8) -> DataFrame:
    """Adds ``split``. Rows are ordered by a seeded digest of their key; the first ones of a stratum are for evaluation.

    The position of a row is counted in digest ranges: range counts give every
    range its offset, so a stratum of any size is ranked by many tasks.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    ranged = cases.withColumn("_h", order).withColumn("_r", F.substring("_h", 1, RANGE_DIGITS))
    per_range = ranged.groupBy(stratum, "_r").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(stratum).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    offsets = per_range.select(
        stratum, "_r", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"), F.sum("_n").over(whole).alias("_total")
    )
    placed = ranged.join(offsets, [stratum, "_r"]).withColumn(
        "_place", F.col("_offset") + F.row_number().over(Window.partitionBy(stratum, "_r").orderBy("_h", key))
    )
    return placed.withColumn(
        "split", F.when(F.col("_place") <= eval_size(F.col("_total"), train_ratio), "eval").otherwise("train")
    ).drop("_h", "_r", "_offset", "_total", "_place")


def _decision(thought: str, action: str, arguments: str) -> Column:
    """Compact JSON with raw argument JSON inside."""
    head = F.to_json(F.struct(F.col(thought).alias("thought"), F.col(action).alias("action")))
    return F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"arguments":'), F.col(arguments), F.lit("}"))


def _expected(action: str, arguments: str) -> Column:
    return F.concat(F.lit('{"action":'), F.to_json(F.array(F.col(action))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(action)))) - 2),
                    F.lit(',"arguments":'), F.col(arguments), F.lit("}"))


def sft_records(cases: DataFrame, prompt: Column) -> DataFrame:
    completion = _decision("thought", "action", "arguments")
    base = cases.select("*", prompt.alias("prompt"), completion.alias("completion"))
    return base.select(
        F.col("case_id").alias("id"), "split", "category", "prompt", "completion",
        F.concat("prompt", "completion").alias("text"),
        F.array(
            F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")),
        ).alias("messages"),
        _expected("action", "arguments").alias("expected"),
    )


def dpo_records(cases: DataFrame, prompt: Column) -> DataFrame:
    return cases.select(
        F.col("case_id").alias("id"), "split", "category", prompt.alias("prompt"),
        _decision("thought", "action", "arguments").alias("chosen"),
        _decision("rejected_thought", "rejected_action", "rejected_arguments").alias("rejected"),
        _expected("action", "arguments").alias("expected"),
        _expected("rejected_action", "rejected_arguments").alias("rejected_decision"),
    )


def split_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count("*").alias("n"))
