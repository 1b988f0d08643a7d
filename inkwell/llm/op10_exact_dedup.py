"""Exact deduplication with disk-backed streaming state.

Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty. The documents are staged
as a content table whose row number is the content locator. A Structured Streaming aggregate reads the table and
keeps, per digest, the keeper's stable identifier, its locator and the group size in RocksDB state without expiry.
Partial aggregates run before the shuffle, so a text that fills a third of the rows reaches its state as one row per
task. Every hit is then checked on its full text against the keeper's; rows whose digests agree but whose texts differ
are grouped again by the text itself.

Defined results: the largest doc_id of a group stays; null identifiers rank lowest; among repeated rows with the same
identifier the later row of the content table stays, and only that one counts as kept. An empty table gives an empty
result. Further columns of the input travel inside one struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import ascii_lower, bounded, new_path, numbered, stage, table

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a store is closed, and its local files go, when its task has committed
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def content_table(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, str]:
    """Stages (row, uid, digest): every document whole, its locator and the digest of its normalised text."""
    spark = docs.sparkSession
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "uid")
    rows = rows.withColumn("digest", digest(normalised(F.col("row.text"))))
    path = new_path(spark, "content")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def keyed_state(spark: SparkSession, content: DataFrame, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Runs the stream to the end of the content table and returns its state: (digest, keeper, group_size).

    ``keeper`` is a struct of doc_id and uid. The result does not depend on how files fall into triggers.
    """
    reader = spark.readStream.schema(content.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    keyed = (
        reader.parquet(path)
        .select("digest", F.struct(F.col("row.doc_id").alias("doc_id"), "uid").alias("keeper"))
        .groupBy("digest")
        .agg(F.max("keeper").alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    )
    checkpoint = new_path(spark, "state")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        writer = keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        if query.lastProgress is None:
            return content.select("digest", "uid").limit(0).select(
                "digest", F.struct(content["row.doc_id"], "uid").alias("keeper"), F.lit(0).cast("bigint").alias("group_size")
            )
        state = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return state.select(
        F.col("key.digest").alias("digest"),
        F.struct(F.col("value.max.doc_id").alias("doc_id"), F.col("value.max.uid").alias("uid")).alias("keeper"),
        F.col("value.count").alias("group_size"),
    )


def decide(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_trigger: int | None = None,
    broadcast_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """Returns the content table and one decision per row: uid, doc_id, digest, keep_id, keep_uid, group_size, kept.

    ``broadcast_rows`` bounds the broadcast of row numbers of grouped rows; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    content, path = content_table(docs, digest)
    state = stage(keyed_state(spark, content, path, files_per_trigger), "groups")
    decisions = stage(
        content.select("uid", F.col("row.doc_id").alias("doc_id"), "digest")
        .join(state, "digest")
        .select("uid", "doc_id", "digest", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.uid").alias("keep_uid"), "group_size"),
        "decisions",
    )

    grouped = decisions.where("group_size > 1").select("uid", "keep_uid")
    texts = stage(
        content.select("uid", normalised(F.col("row.text")).alias("norm")).join(bounded(grouped, broadcast_rows), "uid"), "hits"
    )
    keepers = texts.where("uid = keep_uid").select("keep_uid", F.col("norm").alias("kept_norm"))
    differ = texts.where("uid <> keep_uid").join(keepers, "keep_uid").where("norm <> kept_norm")
    if differ.limit(1).count():
        decisions = _split_by_text(decisions, texts, differ.select("keep_uid").distinct())
    return content, decisions.withColumn("kept", F.col("uid") == F.col("keep_uid"))


def _split_by_text(decisions: DataFrame, texts: DataFrame, clashing: DataFrame) -> DataFrame:
    """Groups rows that share a digest with a different text by the full text."""
    rows = stage(texts.join(clashing, "keep_uid", "left_semi").join(decisions.select("uid", "doc_id"), "uid"), "clashes")
    groups = rows.groupBy("keep_uid", "norm").agg(
        F.max(F.struct("doc_id", "uid")).alias("keeper"), F.count(F.lit(1)).alias("own_size")
    )
    own = rows.select("uid", "keep_uid", "norm").join(groups, ["keep_uid", "norm"]).select("uid", "keeper", "own_size")
    changed = F.col("own_size").isNotNull()
    return stage(
        decisions.join(own, "uid", "left").select(
            "uid", "doc_id", "digest",
            F.when(changed, F.col("keeper.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(changed, F.col("keeper.uid")).otherwise(F.col("keep_uid")).alias("keep_uid"),
            F.coalesce("own_size", "group_size").alias("group_size"),
        ),
        "decisions",
    )


def deduplicated(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents that stay, with their own columns."""
    content, decisions = decide(docs, broadcast_rows=broadcast_rows)
    dropped = bounded(decisions.where(~F.col("kept")).select("uid"), broadcast_rows)
    return content.join(dropped, "uid", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, decisions = decide(docs)
    return decisions.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
