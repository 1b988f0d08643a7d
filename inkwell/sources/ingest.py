"""File ingest: folder scan, checks, decoding, canonical documents, quarantine."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import text as T

# Accepted suffixes. Text of paged files comes in through `assemble_pages`.
TEXT_SUFFIXES = (".txt", ".md", ".markdown")
MARKDOWN_SUFFIXES = (".md", ".markdown")


def _early_reason(settings: Settings) -> Column:
    """Why a file is rejected by its name and size alone."""
    return (
        F.when(~T.file_suffix(F.col("path")).isin(*TEXT_SUFFIXES), "unsupported_suffix")
        .when(F.col("length") == 0, "empty_file")
        .when(F.col("length") > settings.upload_max_bytes, "too_large")
    )


def read_folder(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``path, length, content`` of every file below a folder.

    Only acceptable files are opened: the length filter reaches the scan, and the scan of the others reads no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rejected = _early_reason(settings).isNotNull()
    good = files.where((F.col("length") <= settings.upload_max_bytes) & ~rejected).select("path", "length", "content")
    return good.unionByName(files.where(rejected).select("path", "length", F.lit(None).cast("binary").alias("content")))


def decode_gb18030(raw: Column) -> Column:
    """Arrow UDF for the rare rows that are not UTF-8; NULL when they are not GB18030 either."""

    def one(value):
        if value is None:
            return None
        try:
            return bytes(value).decode("gb18030")
        except UnicodeDecodeError:
            return None

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(one)

    return decode(raw)


def decode_text(files: DataFrame, raw: str = "content", name: str = "text") -> DataFrame:
    """UTF-8 first, in the JVM; only the rest goes through the Python decoder. A byte-order mark stays."""
    tried = files.withColumn("_utf8", F.try_validate_utf8(F.col(raw).cast("string")))
    rest = F.when(F.col("_utf8").isNull(), F.col(raw))
    return tried.withColumn(name, F.coalesce("_utf8", decode_gb18030(rest))).drop("_utf8")


def parse_files(files: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Assets and quarantine of ``files(path, length, content[, title, asset_type])``.

    Assets have ``path, title, asset_type, content``; rejected files have a ``reason``.
    """
    for optional in ("title", "asset_type"):
        if optional not in files.columns:
            files = files.withColumn(optional, F.lit(None).cast("string"))
    keep = ["path", "length", "title", "asset_type", "_suffix", "_name"]
    suffix, name = T.file_suffix(F.col("path")), T.base_name(F.col("path"))
    early = _early_reason(settings)
    wanted = files.withColumn("content", F.when(early.isNull(), F.col("content")))
    decoded = decode_text(wanted.withColumn("_suffix", suffix).withColumn("_name", name))
    markdown = F.col("_suffix").isin(*MARKDOWN_SUFFIXES)
    unified = decoded.select(*keep, T.normalize_newlines(F.col("text")).alias("_text"))
    bodies = unified.select(
        *keep,
        T.collapse_blank_lines(F.when(markdown, T.strip_front_matter(F.col("_text"))).otherwise(F.col("_text"))).alias("_body"),
    )
    parts = bodies.select(
        *keep,
        "_body",
        T.asset_title(F.col("_name"), F.col("title")).alias("_title"),
        F.when(markdown & F.startswith("_body", F.lit("#")), F.element_at(F.split("_body", T.LINE_BREAKS, 2), 1)).alias("_heading"),
    )
    source = T.source_line(F.col("_name"))
    rest = T.lstrip(F.substring("_body", F.length("_heading") + 1, F.length("_body")))
    document = F.when(
        F.col("_heading").isNotNull(), F.concat_ws("\n\n", T.strip(F.col("_heading")), source, F.nullif(rest, F.lit("")))
    ).otherwise(F.concat(F.lit("# "), "_title", F.lit("\n\n"), source, F.lit("\n\n"), "_body"))
    reason = F.coalesce(early, F.when(F.col("_body").isNull(), "unknown_encoding").when(F.col("_body") == "", "no_text"))
    row = F.struct(
        "path", "length", reason.alias("reason"), F.col("_title").alias("title"),
        T.infer_asset_type(F.col("_name"), F.col("asset_type")).alias("asset_type"),
        T.collapse_blank_lines(document).alias("content"),
    )
    # As a generated row, so that the filters below are not copied into the text expressions above.
    parsed = parts.select(F.explode_outer(F.array(row)).alias("f")).select("f.*")
    assets = parsed.where(F.col("reason").isNull()).select("path", "title", "asset_type", "content")
    return assets, parsed.where(F.col("reason").isNotNull()).select("path", "length", "reason")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One document per ``doc_id`` from extracted page texts ``doc_id, title, filename, page_no, text``.

    Pages are cleaned before the shuffle; empty ones are skipped.
    """
    cleaned = pages.withColumn("_text", T.page_text(F.col("text"))).where(F.col("_text") != "")
    marked = F.concat(F.lit("<!-- page:"), F.col("page_no"), F.lit(" -->\n\n"), F.col("_text"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("page_no", marked.alias("t")))), lambda p: p["t"])
    return cleaned.groupBy("doc_id", "title", "filename").agg(F.array_join(body, "\n\n").alias("_body")).select(
        "doc_id",
        T.collapse_blank_lines(
            F.concat(F.lit("# "), "title", F.lit("\n\n"), T.source_line(F.col("filename")), F.lit("\n\n"), "_body")
        ).alias("content"),
    )


#: What ``html.unescape`` looks up, one reference at a time.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(ArrayType(StringType()))
def _decoded(references: pa.Array) -> pa.Array:
    """Lists of references decoded; a distinct one of the batch once, the others stay Arrow strings."""
    coded = references.flatten().dictionary_encode()
    known = pa.array([html.unescape(x) for x in coded.dictionary.to_pylist()], pa.string())
    ends = pa.array(np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(references), 0).to_numpy())), pa.int32())
    return pa.ListArray.from_arrays(ends, known.take(coded.indices))


def clean_html(col: Column) -> Column:
    """Entities decoded, white space collapsed. Only the references leave the JVM, and only from text that has some."""
    found = _decoded(F.when(F.contains(col, F.lit("&")), F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0))).otherwise(T.no_strings()))
    between = F.split(col, REFERENCE, -1)
    whole = F.array_join(F.zip_with(between, found, lambda text, mark: F.concat(text, F.coalesce(mark, F.lit("")))), "")
    return T.collapse_spaces(F.when(F.contains(col, F.lit("&")), whole).otherwise(col))


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
