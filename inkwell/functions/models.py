"""Model functions: the caller brings the model, Spark brings batches and distribution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from inkwell.operators.dense import l2_normalize


def effective_max_length(configured: Column, tokenizer: Column, positions: Column) -> Column:
    """Smallest usable limit, at least 32. Missing or absurd limits do not count."""
    usable = F.array_compact(
        F.array(
            configured,
            F.when((tokenizer > 0) & (tokenizer < 100000), tokenizer),
            F.when(positions > 0, positions),
        )
    )
    return F.greatest(F.lit(32), F.array_min(usable))


def embed(texts: DataFrame, column: str, make_predict: Callable, batch_size: int = 4) -> DataFrame:
    """Adds ``vector``: unit-length embedding. ``make_predict()`` runs once per worker and returns ``texts -> matrix``."""
    encode = predict_batch_udf(make_predict, return_type=ty.ArrayType(ty.FloatType()), batch_size=batch_size)
    return texts.withColumn("_raw", encode(F.col(column))).withColumn("vector", l2_normalize(F.col("_raw"))).drop("_raw")


def score_pairs(pairs: DataFrame, make_predict: Callable, batch_size: int = 2) -> DataFrame:
    """``query_id, chunk_id, rerank_score`` for candidate pairs ``query, title, content``; the passage is title and text."""
    passage = F.concat_ws("\n", "title", "content")
    score = predict_batch_udf(make_predict, return_type=ty.DoubleType(), batch_size=batch_size)
    return pairs.select("query_id", "chunk_id", score(F.col("query"), passage).alias("rerank_score"))
