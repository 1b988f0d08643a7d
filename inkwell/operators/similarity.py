"""Thresholded similarity self-join of vectors: near-duplicate questions.

Equal vectors form a class and are compared once. Every class gets keys from a few tables; a key names which of the table's
random directions, or which opposite of one, the vector lies closest to. Two classes meet if a key agrees. Directions are
drawn independently, so the chance that a pair meets depends on its cosine alone; the number of tables follows from
the threshold: a pair exactly at it meets nowhere with probability ``miss``. A table has at least ``DIRECTIONS`` directions
and more only where buckets would pass half a block, so the tables a class enters, and with them the rows shuffled a class, stay nearly the same as the input grows.

Buckets are counted before any vector is shipped; single rows drop out. A bucket of more than ``BLOCK`` classes is cut by
hash into blocks and every pair of its blocks becomes a group of its own, so no group is unbounded and no pair is lost. A
vector is shipped once a table as packed floats with its short keys. A group is a row of small matrix products; single
precision decides what is far below the threshold, double precision the rest. A pair that also met in an earlier table is left to that table, so links are counted without
a distinct over pairs; a group returns per class its number of links and the least class it is connected to, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.identity import components
from inkwell.config import DEFAULTS
from inkwell.session import materialized, shuffle_partitions, within_rows

BLOCK = 8192
#: Rows of one product inside a group.
TILE = 1024
#: Directions of a table, at least and at most; a table has two buckets a direction.
DIRECTIONS, MOST_DIRECTIONS = 64, 4096
#: Drawn pairs for the chance of meeting; a lower bound of it counts.
DRAWS = 16_384
#: Bytes of shipped vectors a shuffle partition should hold.
PARTITION_BYTES = 64 << 20
SEED = 20_011
DIGITS = 9


def band_plan(threshold: float, rows: int, miss: float = 1e-6) -> tuple[int, int]:
    """Bits a band and bands of sign bits, for comparison with ``table_plan``: chance buckets of about 32 rows."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = max(4, min(20, math.ceil(math.log2(max(rows, 2) / 32))))
    met = min(agree**bits, 1 - 1e-12)
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-met)))


@lru_cache(maxsize=64)
def meeting_chance(threshold: float, directions: int) -> float:
    """Chance that two vectors of cosine ``threshold`` have the same key in a table, four standard errors below the drawn share."""
    rng, met = np.random.default_rng(SEED), 0
    for k in range(0, DRAWS, 1024):
        one = rng.standard_normal((1024, directions))
        other = threshold * one + math.sqrt(max(0.0, 1 - threshold**2)) * rng.standard_normal(one.shape)
        met += int((_keys(one[:, None]) == _keys(other[:, None])).sum())
    share = met / DRAWS
    return max(share - 4 * math.sqrt(share * (1 - share) / DRAWS), 0.25 / directions**2)


def table_plan(threshold: float, rows: int, miss: float = 1e-6, block: int = BLOCK) -> tuple[int, int]:
    """Directions a table and tables: buckets of about half a block at most, and ``miss`` for a pair at the threshold."""
    directions = min(max(DIRECTIONS, 1 << max(0, math.ceil(math.log2(max(rows, 1) / max(block, BLOCK))))), MOST_DIRECTIONS)
    chance = min(meeting_chance(max(0.0, min(1.0, threshold)), directions), 1 - 1e-12)
    return directions, max(1, math.ceil(math.log(miss) / math.log1p(-chance)))


def _keys(projected: np.ndarray) -> np.ndarray:
    """``(rows, tables)`` keys from ``(rows, tables, directions)``: twice the closest direction, plus one for its opposite."""
    closest = np.abs(projected).argmax(axis=2)
    return 2 * closest + (np.take_along_axis(projected, closest[:, :, None], 2)[:, :, 0] < 0)


def _unit(column: pd.Series, width: str) -> np.ndarray:
    matrix = np.frombuffer(b"".join(column), width).reshape(len(column), -1).astype(np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _signed(frames: Iterator[pd.DataFrame], dims: int, directions: int, tables: int, width: str) -> Iterator[pd.DataFrame]:
    axes = np.random.default_rng(SEED).standard_normal((dims, directions * tables))
    step = max(1, min(2048, (1 << 22) // (directions * tables)))
    for frame in frames:
        for k in range(0, len(frame), step):
            part = frame.iloc[k : k + step]
            packed = [np.asarray(v, width).tobytes() for v in part["vector"]]
            keys = _keys((_unit(pd.Series(packed), width) @ axes).reshape(len(part), tables, directions))
            yield pd.DataFrame({"class_id": part["class_id"].to_numpy(), "packed": packed, "keys": [k.tobytes() for k in keys.astype("<u2")], "places": list(keys)})


def _linked(group: pd.DataFrame, threshold: float, width: str) -> pd.DataFrame:
    """Per class of the group: the least class connected to it here, and its links that no earlier table has."""
    group = group.sort_values("class_id", ignore_index=True)
    first, second, place = int(group["first"].iloc[0]), int(group["second"].iloc[0]), int(group["place"].iloc[0])
    ids, block = group["class_id"].to_numpy(), group["block"].to_numpy()
    unit = _unit(group["packed"], width)
    single = unit.astype(np.float32)
    earlier = np.frombuffer(b"".join(group["keys"]), "<u2").reshape(len(group), -1)[:, :place]
    low = np.float32(threshold - 1e-6 * max(10.0, math.sqrt(unit.shape[1])))
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    # ``root`` is the least row known to be connected; rows are in the order of their ids.
    root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for x in range(0, len(a), TILE):
        rows = a[x : x + TILE]
        for y in range(x if first == second else 0, len(b), TILE):
            columns = b[y : y + TILE]
            i, j = np.nonzero(single[rows] @ single[columns].T >= low)
            i, j = rows[i], columns[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            parts = []
            for k in range(0, len(i), 8192):
                p, q = i[k : k + 8192], j[k : k + 8192]
                hit = (np.round(np.einsum("nd,nd->n", unit[p], unit[q]), DIGITS) >= threshold) & (earlier[p] != earlier[q]).all(axis=1)
                parts.append((p[hit], q[hit]))
            i, j = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (i, j)
            if not len(i):
                continue
            links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            bonds = np.unique(np.stack([root[i], root[j]]), axis=1)
            moved = np.arange(len(ids))
            while True:
                before = moved.copy()
                np.minimum.at(moved, bonds[0], before[bonds[1]])
                np.minimum.at(moved, bonds[1], before[bonds[0]])
                if (moved == before).all():
                    break
            root = moved[root]
    on = links > 0
    return pd.DataFrame({"class_id": ids[on], "least": ids[root[on]], "links": links[on]})


def near_duplicates(vectors: DataFrame, threshold: float, miss: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """``id, class_id, n_copies, n_links, component`` of ``vectors(id, vector)``.

    ``class_id`` is the smallest id with an equal vector, ``n_links`` the number of other classes of cosine ``threshold`` or more
    (rounded to nine digits), ``component`` the smallest id reachable over links. A vector that is null, empty, zero, not
    finite or of another width than the widest is alone in its class, together with equal ones.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "vector").where("id IS NOT NULL")
    classes = materialized(rows.groupBy("vector").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies")), "similarity-classes")
    length = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = classes.withColumn("_length", length).where("_length > 0 AND _length < double('infinity') AND NOT isnan(_length)").drop("_length")
    dims, count = usable.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    every = classes.select(F.col("vector").alias("_vector"), "class_id", "n_copies")
    rows = rows.join(every, F.col("vector").eqNullSafe(F.col("_vector"))).select("id", "class_id", "n_copies")
    if not count:
        return rows.withColumns({"n_links": F.lit(0).cast("bigint"), "component": F.col("class_id")})

    directions, tables = table_plan(threshold, count, miss, block)
    id_type = classes.schema["class_id"].dataType.simpleString()
    width = "<f4" if classes.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    signed = materialized(
        usable.where(F.size("vector") == dims)
        .select("class_id", "vector")
        .mapInPandas(lambda f: _signed(f, dims, directions, tables, width), f"class_id {id_type}, packed binary, keys binary, places array<int>"),
        "similarity-signed",
    )
    buckets = (
        signed.select(F.posexplode_outer("places").alias("place", "key"))
        .groupBy("place", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("place", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    buckets = materialized(buckets, "similarity-buckets")
    if within_rows(buckets, DEFAULTS.broadcast_max_rows):
        buckets = F.broadcast(buckets)
    met = (
        signed.select("class_id", "packed", "keys", F.posexplode_outer("places").alias("place", "key"))
        .join(buckets, ["place", "key"])
        .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class_id", "packed", "keys", "place", "key", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    )
    group = ["place", "key", "first", "second"]
    shipped = count * tables * (dims * int(width[-1]) + 2 * tables + 64)
    # An explicit count keeps small groups on different tasks.
    partitions = max(shuffle_partitions(spark), -(-shipped // PARTITION_BYTES))
    found = materialized(
        met.repartition(partitions, *group).groupBy(*group).applyInPandas(
            lambda g: _linked(g, threshold, width), f"class_id {id_type}, least {id_type}, links bigint"
        ),
        "similarity-links",
    )
    links = found.groupBy("class_id").agg(F.sum("links").alias("n_links"))
    edges = found.where("class_id <> least").select("class_id", "least").distinct()
    ends = edges.select(F.explode(F.array("class_id", "least")).alias("id"), F.concat_ws("-", "class_id", "least").alias("key"))
    joined = components(ends).withColumnRenamed("id", "class_id")
    return (
        rows.join(links, "class_id", "left")
        .join(joined, "class_id", "left")
        .select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    )
