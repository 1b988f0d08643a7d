"""Exact dense retrieval over vector tables.

Each task multiplies its Arrow batches with the matrix of query vectors and
keeps a running top-k per query, so a task emits at most ``k`` rows per query
whatever the size of its partition. The matrix is sent to the tasks only after
a count shows that the query set fits one block. Larger query sets are split
into blocks that meet the vectors in (block, bucket) groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.operators.retrieval import SCORE_DIGITS, bucket_of
from inkwell.session import shuffle_partitions, within_rows


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit vector in double precision; a zero vector stays zero."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda v: v.cast("double") / length)).otherwise(
        F.transform(vector, lambda v: v.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """``group, vector``: unit-length mean vector per group, summed per dimension before the shuffle."""
    parts = vectors.select(group, F.posexplode("vector").alias("dim", "v"))
    means = parts.groupBy(group, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"])
    return means.groupBy(group).agg(ordered.alias("vector")).withColumn("vector", l2_normalize(F.col("vector")))


def _unit_rows(column) -> np.ndarray:
    matrix = np.asarray(column.tolist(), dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best_rows(ids, pos, scores: np.ndarray, query_ids, k: int) -> pd.DataFrame:
    """Top ``k`` rows per query column, ties by ``pos``; every tie at the cut is kept in order."""
    frames = []
    for j, query_id in enumerate(query_ids):
        column = scores[:, j]
        order = np.lexsort((pos, -column))[:k]
        frames.append(
            pd.DataFrame({"query_id": query_id, "chunk_id": ids[order], "pos": pos[order], "score": column[order]})
        )
    return pd.concat(frames, ignore_index=True)


def _fold(best: pd.DataFrame | None, fresh: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = fresh if best is None else pd.concat([best, fresh], ignore_index=True)
    rows = rows.sort_values(["query_id", "score", "pos"], ascending=[True, False, True], kind="stable")
    return rows.groupby("query_id", sort=False).head(k)


def dense_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    settings: Settings = DEFAULTS,
    scope: DataFrame | None = None,
) -> DataFrame:
    """``query_id, chunk_id, pos, score, rank``: the ``k`` nearest vectors by cosine.

    ``queries(query_id, vector)``, ``vectors(chunk_id, pos, vector)``. The payload
    filter ``scope(chunk_id)`` runs before scoring.
    """
    if scope is not None:
        vectors = vectors.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi")
    schema = (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, pos bigint, score double"
    )
    vectors = vectors.select("chunk_id", F.col("pos").cast("bigint").alias("pos"), "vector")
    if within_rows(queries, settings.dense_block_rows):
        hits = _broadcast_topk(queries, vectors, k, schema)
    else:
        hits = _blocked_topk(queries, vectors, k, schema, settings)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("pos"), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _broadcast_topk(queries: DataFrame, vectors: DataFrame, k: int, schema: str) -> DataFrame:
    block = queries.select("query_id", "vector").orderBy("query_id").toPandas()  # at most one counted block
    shared = vectors.sparkSession.sparkContext.broadcast(
        (block["query_id"].to_numpy(), _unit_rows(block["vector"]) if len(block) else None)
    )

    def score(batches):
        query_ids, matrix = shared.value
        if matrix is None:
            return
        best = None
        for batch in batches:
            if len(batch):
                scores = np.round(_unit_rows(batch["vector"]) @ matrix.T, SCORE_DIGITS)
                fresh = _best_rows(batch["chunk_id"].to_numpy(), batch["pos"].to_numpy(), scores, query_ids, k)
                best = _fold(best, fresh, k)
        if best is not None:
            yield best

    return vectors.mapInPandas(score, schema)


def _blocked_topk(queries: DataFrame, vectors: DataFrame, k: int, schema: str, settings: Settings) -> DataFrame:
    """Query blocks of bounded size meet hashed slices of the vectors in one task each."""
    n_queries = queries.count()
    n_vectors = vectors.count()
    blocks = max(1, -(-2 * n_queries // settings.dense_block_rows))
    slices = max(shuffle_partitions(vectors.sparkSession), -(-n_vectors // 50_000))
    left = queries.select(
        "query_id",
        "vector",
        bucket_of(F.col("query_id"), blocks).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
    )
    right = vectors.select(
        "*",
        bucket_of(F.col("chunk_id"), slices).alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "pos": [], "score": []})
        scores = np.round(_unit_rows(v["vector"]) @ _unit_rows(q["vector"]).T, SCORE_DIGITS)
        return _best_rows(v["chunk_id"].to_numpy(), v["pos"].to_numpy(), scores, q["query_id"].to_numpy(), k)

    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(score, schema)
