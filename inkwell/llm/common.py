"""Helpers of the training-data operators: the shared folder, staged tables, plain lower case.

The shared folder is ``spark.checkpoint.dir`` of the session. Only a local session without that setting gets a
temporary folder of its own; on a cluster a missing setting is an error, because executors could not see the files.
"""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_local_dirs: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="inkwell-llm-"))
    return f"{root.rstrip('/')}/inkwell-llm/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def working_tables() -> Iterator[list[str]]:
    """The paths that are made inside the ``with`` block."""
    first, inside = len(_made), []
    try:
        yield inside
    finally:
        inside += _made[first:]


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables; nothing that still has to run may read them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while paths:
        path = hadoop.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: later steps neither repeat the work nor lose it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes every staged table of this application; call it when its results have been stored."""
    delete_tables(spark, [shared_dir(spark)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only. A text of ASCII bytes takes the quick built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a row number that is unique, not dense; it is stable only once the result has been staged."""
    return df.withColumn(name, F.monotonically_increasing_id())


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks ``df`` for a broadcast if a count proves that it has at most ``max_rows`` rows; else Spark shuffles the join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
