"""Corpus identity: rows are the same if any of several normalised keys agree, directly or over other rows.

Components come from label hooking and pointer jumping over the (id, key) table. A round takes the least label of each key,
hooks every label to the least label that its rows see, and halves the chains of labels; rounds grow with the logarithm
of the longest chain. Every step is a map-side combined aggregate or a join with one row per key or label, so a key
or a component that holds a third of the rows is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import materialized

EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def normalised(text: Column) -> Column:
    """Lower-case letters and digits, everything between them one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def digest_key(kind: str, text: Column) -> Column:
    """A key that says what it was made of; null texts give no key."""
    return F.when(text.isNotNull(), F.concat(F.lit(f"{kind}:"), F.sha2(text, 256)))


def key_rows(rows: DataFrame, id_column: str, keys: list[Column]) -> DataFrame:
    """``id, key`` with one row for each key that a row has."""
    return rows.select(F.col(id_column).alias("id"), F.explode_outer(F.array(*keys)).alias("key")).where("id IS NOT NULL AND key IS NOT NULL")


def components(keys: DataFrame) -> DataFrame:
    """``id, component`` of a table (id, key): the smallest id reachable over shared keys. Ids without shared keys are absent."""
    keys = materialized(keys.select("id", "key").distinct(), "identity-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    links = materialized(keys.join(shared, "key", "left_semi"), "identity-links")
    labels = materialized(links.select("id", F.col("id").alias("label")).distinct(), "identity-labels")
    while True:
        of_key = links.join(labels, "id").groupBy("key").agg(F.min("label").alias("least"))
        seen = links.join(of_key, "key").groupBy("id").agg(F.min("least").alias("least"))
        hooks = materialized(labels.join(seen, "id").groupBy("label").agg(F.min("least").alias("parent")), "identity-hooks")
        if not hooks.where("parent < label").limit(1).count():
            return labels.withColumnRenamed("label", "component")
        for _ in range(2):  # chains of hooks get a quarter as long
            above = hooks.select(F.col("label").alias("parent"), F.col("parent").alias("grand"))
            hooks = hooks.join(above, "parent", "left").select("label", F.coalesce("grand", "parent").alias("parent"))
        labels = materialized(labels.join(hooks, "label").select("id", F.col("parent").alias("label")), "identity-labels")


def identity_classes(rows: DataFrame, id_column: str, keys: list[Column]) -> DataFrame:
    """``id, component, kept`` for every id: the smallest id of the class stays. A row without keys is alone."""
    found = components(key_rows(rows, id_column, keys)).withColumnRenamed("id", "_id")
    every = rows.select(F.col(id_column).alias("id")).where("id IS NOT NULL").distinct()
    component = F.coalesce("component", "id")
    return every.join(found, F.col("id") == F.col("_id"), "left").select("id", component.alias("component"), (component == F.col("id")).alias("kept"))
