"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame. All but
the last return the columns of ``documents``; the last returns the mix: doc_id, source, size, source_size, target, taken.
Null, empty and repeated rows, empty tables and further columns are handled as each operator's docstring says.

The result of a stage is written before the next stage begins. So every stage starts by deleting the working tables of the
one before, which no later step reads; the disk holds one stage's tables and the last result at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import op1_quality, op2_mixing, op6_decontaminate, op7_minhash, op10_exact_dedup
from inkwell.llm.common import delete_tables, stage, table, working_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_finished: list[str] = []


def alone(step: Stage) -> Stage:
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_tables(spark, _finished)
        with working_tables() as made:
            out = step(spark, docs, sf_dir)
        _finished.extend(made)
        return out

    return run_step


@alone
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_quality.accepted(docs, table(spark, sf_dir, "labels"))


@alone
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_exact_dedup.deduplicated(docs)


@alone
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_minhash.deduplicated(docs)


@alone
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@alone
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_mixing.taken(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Perplexities, hashed windows and hash order have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        kept = step(spark, docs, sf_dir)
        with working_tables() as result:
            docs = stage(kept, f"pipeline-{name}")
        delete_tables(spark, last)
        last = result
    return STAGES[-1][1](spark, docs, sf_dir)
