"""Resumable uploads as tables: part checks, completeness, resume checks, finalising.

``uploads(upload_id, file_md5, file_size, chunk_size, status)`` and
``parts(upload_id, part_index, n_bytes[, arrived_at])``. A part may be
delivered any number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.operators.segments import segment_of

PART_SEGMENT = 1024


def part_bytes(requested: Column, settings: Settings = DEFAULTS) -> Column:
    return F.least(F.greatest(requested, F.lit(1)), F.lit(settings.upload_part_bytes))


def total_parts(file_size: Column, part_size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(file_size / part_size)).cast("int")


def expected_bytes(index: Column, total: Column, file_size: Column, part_size: Column) -> Column:
    """Every part has the part size; the last one holds the remainder."""
    return F.when(index < total - 1, part_size).otherwise(file_size - part_size * (total - 1))


def register_uploads(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Upload rows from requests; over-long files get an error instead of parts."""
    size = part_bytes(F.col("chunk_size"), settings)
    too_big = F.col("file_size") > settings.resumable_max_bytes
    return requests.select(
        F.lower(F.trim("file_md5")).alias("upload_id"),
        "file_md5",
        "filename",
        "file_size",
        size.cast("bigint").alias("chunk_size"),
        total_parts(F.col("file_size"), size).alias("total_chunks"),
        F.when(too_big, F.concat(F.lit("Uploaded file exceeds "), F.lit(settings.resumable_max_bytes), F.lit(" bytes"))).alias("error"),
    )


def check_parts(parts: DataFrame, uploads: DataFrame) -> DataFrame:
    """Adds ``problem`` to every part: unknown upload, out of range, wrong size, or NULL when it counts."""
    known = uploads.select("upload_id", "file_size", "chunk_size", "total_chunks")
    joined = parts.join(known, "upload_id", "left")
    index, total = F.col("part_index"), F.col("total_chunks")
    wanted = expected_bytes(index, total, F.col("file_size"), F.col("chunk_size"))
    return joined.withColumn(
        "problem",
        F.when(total.isNull(), "unknown_upload")
        .when((index < 0) | (index >= total), "out_of_range")
        .when(F.col("n_bytes") != wanted, "size_mismatch"),
    )


def completeness(parts: DataFrame, uploads: DataFrame) -> DataFrame:
    """Received and missing parts per upload.

    Parts are reduced per (upload, segment) first. The final row holds at most
    ``total_chunks`` numbers, which the size limit bounds.
    """
    good = check_parts(parts, uploads).where(F.col("problem").isNull())
    segments = good.groupBy("upload_id", segment_of(F.col("part_index"), PART_SEGMENT).alias("segment")).agg(
        F.collect_set("part_index").alias("received")
    )
    received = segments.groupBy("upload_id").agg(F.array_sort(F.flatten(F.collect_list("received"))).alias("received"))
    none = F.array().cast("array<bigint>")
    joined = uploads.join(received, "upload_id", "left").withColumn(
        "received", F.coalesce(F.col("received").cast("array<bigint>"), none)
    )
    everything = F.sequence(F.lit(0).cast("bigint"), (F.col("total_chunks") - 1).cast("bigint"))
    return joined.withColumn("missing", F.array_except(everything, "received")).withColumn(
        "uploaded_count", F.size("received")
    ).withColumn("complete", F.col("uploaded_count") == F.col("total_chunks"))


def resume_problems(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Resumed uploads whose digest or size differs from the stored upload."""
    stored = uploads.select("upload_id", F.col("file_md5").alias("_md5"), F.col("file_size").alias("_size"))
    joined = requests.join(stored, "upload_id")
    mismatches = F.array_compact(
        F.array(
            F.when((F.coalesce("_md5", F.lit("")) != "") & (F.col("_md5") != F.col("file_md5")), "file_md5"),
            F.when(F.col("_size") != F.col("file_size"), "file_size"),
        )
    )
    return joined.withColumn("mismatches", mismatches).where(F.size("mismatches") > 0).drop("_md5", "_size")


def finalize(status: DataFrame, digests: DataFrame) -> DataFrame:
    """Outcome of completing uploads; ``digests(upload_id, merged_md5)`` comes from the stored object."""
    joined = status.join(digests, "upload_id", "left")
    return joined.withColumn(
        "outcome",
        F.when(F.coalesce("status", F.lit("")) == "finalized", "already_finalized")
        .when(F.size("missing") > 0, "incomplete")
        .when(F.coalesce("merged_md5", F.lit("")) != F.col("upload_id"), "md5_mismatch")
        .otherwise("finalized"),
    )
