"""Session helpers used by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "inkwell", cores: str | None = None) -> SparkSession:
    """Local session for tests and bench. On a cluster, pass the cluster's own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than cores, before CPU-heavy text work.

    Meant for plain scans of small or single-block files. A large table already
    has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def within_rows(df: DataFrame, max_rows: int) -> bool:
    """True when a bounded probe proves that ``df`` has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests) gets a temporary folder of its own; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="inkwell-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage for a table that several branches read, and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/inkwell/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def null_safe_count(condition) -> F.Column:
    """Number of rows where the condition holds, 0 for no rows."""
    return F.coalesce(F.count_if(condition), F.lit(0))
