"""Chunk index and fact table as append-only Parquet logs with latest-wins reads.

A table is a folder of change batches, ``path/batch=NAME``. A batch is written once, as plain Parquet, and holds only what
changed: no file of an earlier batch is read or written. Writing a batch of the same name again replaces it, so a
retried micro-batch is harmless. Reads keep the newest version of every key; :func:`compact_chunks` and
:func:`compact_facts` write what a read returns as a new table, whose file count follows from its size.

* Chunks: the largest ``version`` of an asset wins, whenever it arrives; among equal versions the batch whose name sorts
  last. Every change leaves one mark row (``chunk_id`` NULL), so an emptied or deleted asset hides its older chunks.
* Facts: the latest draft of a key wins, by its own time and not by arrival. A deleted project hides its facts up to
  the time of the deletion.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.operators.chunking import chunk_documents
from inkwell.operators.memory import upsert_facts
from inkwell.session import within_rows

BASE = "base"
CHUNK_SCHEMA = (
    "asset_id string, chunk_id string, title string, asset_type string, content string, source_path string, chunk_level string, "
    "parent_id string, section_path string, page_start int, page_end int, token_count int, pos bigint"
)
CHUNK_LOG = f"{CHUNK_SCHEMA}, version bigint, op string, batch string"
FACT_KEY = ["project_id", "fact_type", "memory_key"]
FACT_ORDER = ["updated_at", "session_id", "sequence_id", "position"]
FACT_LOG = (
    "project_id string, fact_type string, memory_key string, session_id string, sequence_id bigint, position int, statement string, "
    "subject string, predicate string, object string, importance double, metadata string, updated_at timestamp, op string, batch string"
)


def new_batch() -> str:
    """Name of a batch that is written once; later ones sort last."""
    return f"direct-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _append(rows: DataFrame, path: str, schema: str, batch: str) -> None:
    wanted = rows.sparkSession.createDataFrame([], schema).drop("batch").schema
    fitted = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
    fitted.write.mode("overwrite").parquet(f"{path}/batch={batch}")


# --- chunks -------------------------------------------------------------------------------


def _marks(log: DataFrame) -> DataFrame:
    """The newest change of every asset: ``asset_id, version, batch, op``."""
    newest = F.max(F.struct("version", "batch", "op")).alias("m")
    return log.where(F.col("chunk_id").isNull()).groupBy("asset_id").agg(newest).select("asset_id", "m.*")


def _living(log: DataFrame, broadcast_rows: int) -> DataFrame:
    """Chunk rows of the newest change of each asset. Superseded changes are few after a compaction and then broadcast."""
    change = ["asset_id", "version", "batch"]
    marks = log.where(F.col("chunk_id").isNull()).select(*change)
    stale = marks.join(_marks(log).select(*change), change, "left_anti")
    if within_rows(stale, broadcast_rows):
        stale = F.broadcast(stale)
    return log.where(F.col("chunk_id").isNotNull()).join(stale, change, "left_anti")


def read_chunks(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    return _living(_log(spark, path, CHUNK_LOG), settings.broadcast_max_rows).drop("version", "op", "batch")


def apply_asset_changes(changes: DataFrame, path: str, settings: Settings = DEFAULTS, batch: str | None = None) -> None:
    """Index change feed: ``op (upsert|delete), asset_id, title, asset_type, content, version[, asset_pos]``.

    Within the batch the newest change per asset counts (equal versions: the largest row); an older version than the
    stored one is kept in the log but never read.
    """
    payload = [c for c in ("op", "title", "asset_type", "content", "asset_pos") if c in changes.columns]
    newest = F.max(F.struct(F.col("version").cast("bigint").alias("version"), *payload)).alias("c")
    latest = changes.groupBy("asset_id").agg(newest).select("asset_id", "c.*")
    versions = latest.select("asset_id", "version", "op")
    columns = changes.sparkSession.createDataFrame([], CHUNK_SCHEMA).schema
    marks = versions.select(*[F.col("asset_id") if f.name == "asset_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in columns], "version", "op")
    fresh = chunk_documents(latest.where(F.col("op") == "upsert"), settings, carry=("version", "op"))
    _append(fresh.select(*marks.columns).unionByName(marks), path, CHUNK_LOG, batch or new_batch())


def delete_assets(keys: DataFrame, path: str, batch: str | None = None) -> None:
    """Removes all chunks of the assets in ``keys(asset_id)``; a later version brings an asset back."""
    marks = _marks(_log(keys.sparkSession, path, CHUNK_LOG)).join(keys.select("asset_id").distinct(), "asset_id", "left_semi")
    gone = marks.select(
        F.lit("delete").alias("op"), "asset_id", F.lit("").alias("title"), F.lit("").alias("asset_type"),
        F.lit("").alias("content"), (F.col("version") + 1).alias("version"),
    )
    apply_asset_changes(gone, path, batch=batch)


def compact_chunks(spark: SparkSession, path: str, target: str, settings: Settings = DEFAULTS) -> None:
    """Writes the living chunks and the newest marks of ``path`` as the new table ``target``, ordered by asset."""
    log = _log(spark, path, CHUNK_LOG)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema if f.name not in ("asset_id", "version", "op", "batch")]
    marks = _marks(log).select("asset_id", "version", "op", *empty)
    rows = _living(log, settings.broadcast_max_rows).drop("batch").unionByName(marks)
    _append(rows.repartitionByRange("asset_id").sortWithinPartitions("asset_id"), target, CHUNK_LOG, BASE)


# --- facts --------------------------------------------------------------------------------


def _newest_drafts(drafts: DataFrame) -> DataFrame:
    values = [c for c in drafts.columns if c not in FACT_KEY]
    latest = F.max_by(F.struct(*values), F.struct(*FACT_ORDER)).alias("v")
    return drafts.groupBy(*FACT_KEY).agg(latest).select(*FACT_KEY, "v.*")


def _living_facts(log: DataFrame, broadcast_rows: int) -> DataFrame:
    gone = log.where(F.col("op") == "delete").groupBy("project_id").agg(F.max("updated_at").alias("gone_at"))
    if within_rows(gone, broadcast_rows):
        gone = F.broadcast(gone)
    rows = log.where(F.col("op") == "upsert").join(gone, "project_id", "left")
    return rows.where(F.col("gone_at").isNull() | (F.col("updated_at") > F.col("gone_at"))).drop("gone_at", "op", "batch")


def read_facts(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    return upsert_facts(_living_facts(_log(spark, path, FACT_LOG), settings.broadcast_max_rows))


def apply_fact_drafts(drafts: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends the newest draft of every key of the batch."""
    wanted = [c.split()[0] for c in FACT_LOG.split(", ")[:-2]]
    _append(_newest_drafts(drafts.select(*wanted)).withColumn("op", F.lit("upsert")), path, FACT_LOG, batch or new_batch())


def delete_project_facts(keys: DataFrame, path: str, as_of: Column, batch: str | None = None) -> None:
    """Hides the facts of ``keys(project_id)`` that are not newer than ``as_of``."""
    named = keys.select("project_id").distinct().withColumn("updated_at", as_of.cast("timestamp")).withColumn("op", F.lit("delete"))
    missing = [f for f in keys.sparkSession.createDataFrame([], FACT_LOG).schema if f.name not in (*named.columns, "batch")]
    gone = named.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    _append(gone, path, FACT_LOG, batch or new_batch())


def compact_facts(spark: SparkSession, path: str, target: str, settings: Settings = DEFAULTS) -> None:
    """Writes the newest draft of every living key of ``path``, and its deletions, as the new table ``target``."""
    log = _log(spark, path, FACT_LOG)
    rows = _newest_drafts(_living_facts(log, settings.broadcast_max_rows)).withColumn("op", F.lit("upsert"))
    deletions = log.where(F.col("op") == "delete").drop("batch")
    _append(rows.unionByName(deletions), target, FACT_LOG, BASE)


def fact_payload(facts: DataFrame) -> DataFrame:
    """Flat index payload of facts."""
    return facts.select(
        F.col("id").alias("fact_id"), F.col("id").alias("chunk_id"), "project_id",
        F.coalesce("session_id", F.lit("")).alias("session_id"), "sequence_id", "fact_type", "memory_key",
        F.concat_ws(":", "fact_type", "memory_key").alias("title"), "statement", F.col("statement").alias("content"),
        "subject", "predicate", "object", "importance", "metadata",
    )
