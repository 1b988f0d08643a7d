"""WARC as a PySpark data source: ``spark.read.format("inkwell_warc")`` and ``df.write.format("inkwell_warc")``.

Reading. Files are planned into partitions of similar size. Equality, IN, null and prefix predicates on header columns
are pushed into the reader, which parses the headers of a record first and skips the rest of a record that they
reject. A compressed record is one gzip member; the writer stores the member's length in a gzip extra field, so a
rejected record is skipped without inflating it (archives of other writers are inflated and discarded). The option
``payload`` says what is wanted of accepted records: ``full``, ``digest`` (length and SHA-256) or ``none``.

Writing. Each task rolls its files at ``max_file_bytes`` (option), under hidden names that only the commit renames, so
a lost or repeated task leaves no records behind. Paths may be local, ``file:``, ``hdfs:`` or ``s3:`` URIs.

``write_pages`` stores pages and revisits equal payloads of at least ``min_revisit_bytes``: the smallest page_id is the
response (null ids rank last; of repeated rows one is the response). Defined results: null html is an empty payload, a
null or multi-line url loses its line breaks, an empty table writes an archive without records, further columns are
not read. Page ids are integers.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage,
)

from inkwell.llm.common import new_path, numbered, stage, table

FORMAT = "inkwell_warc"
HEADER_OF = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "block_type": "content-type", "header_digest": "warc-payload-digest",
}
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, block_type string, "
    "header_digest string, headers map<string,string>, payload_bytes bigint, payload_sha256 string, payload binary"
)
HTTP = "application/http"
CHUNK = 1 << 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class WarcSource(DataSource):
    """Options: path, payload (full, digest, none), partition_bytes, max_file_bytes, compress (true, false)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "full")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []
        if self.payload not in ("full", "digest", "none"):
            raise ValueError(f"payload must be full, digest or none, not {self.payload}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            header = HEADER_OF.get(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if header and isinstance(f, EqualTo | EqualNullSafe | In | IsNotNull | IsNull | StringStartsWith):
                self.tests.append((header, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = file_system(self.path)
        infos = [i for i in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file]
        names = sorted((i.path, i.size) for i in infos if i.path.endswith((".warc", ".warc.gz")) and i.base_name[0] not in "._")
        planned, size = [[]], 0
        for name, length in names:
            if planned[-1] and size + length > self.partition_bytes:
                planned.append([])
                size = 0
            planned[-1].append(name)
            size += length
        return [Files(names) for names in planned]

    def accepts(self, headers: dict[str, str]) -> bool:
        for header, test, want in self.tests:
            have = headers.get(header)
            ok = {
                "EqualTo": have is not None and have == want,
                "EqualNullSafe": have == want,
                "In": have is not None and isinstance(want, tuple | list) and have in want,
                "IsNotNull": have is not None,
                "IsNull": have is None,
                "StringStartsWith": have is not None and isinstance(want, str) and have.startswith(want),
            }[test]
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows, size = [], 0
        for name in partition.paths:
            with system.open_input_file(name) as raw:
                for headers, payload in records(raw, name.endswith(".gz"), self.accepts, self.payload != "none"):
                    row = {column: headers.get(h) for column, h in HEADER_OF.items()}
                    row["headers"] = list(headers.items())
                    if payload is not None:
                        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest()}
                        row["payload"] = payload if self.payload == "full" else None
                    rows.append(row)
                    size += len(payload or b"") * (self.payload == "full") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


ARROW = pa.schema(
    [(c, pa.string()) for c in HEADER_OF]
    + [("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("payload", pa.binary())]
)


class _Plain:
    """Bytes of a file in order; skipping moves the position without reading."""

    def __init__(self, raw):
        self.raw, self.kept = raw, b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.kept.find(mark)) < 0:
            more = self.raw.read(CHUNK)
            if not more:
                return b""
            self.kept += more
        out, self.kept = self.kept[: at + len(mark)], self.kept[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        if len(self.kept) < n:
            self.kept += self.raw.read(n - len(self.kept))
        out, self.kept = self.kept[:n], self.kept[n:]
        if len(out) < n:
            raise EOFError("the archive ends inside a record")
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.kept))
        self.kept = self.kept[inside:]
        if n > inside:
            self.raw.seek(self.raw.tell() + n - inside)


def member_length(extra: bytes) -> int | None:
    """Length of the whole gzip member from the extra field ``sl``, if it is there."""
    at = 0
    while at + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", extra, at + 4)[0]
        at += 4 + size
    return None


class _Inflated:
    """The bytes of one gzip member, inflated as far as they are asked for."""

    def __init__(self, raw):
        self.raw, self.start = raw, raw.tell()
        head = raw.read(12)
        extra = raw.read(struct.unpack_from("<H", head, 10)[0]) if len(head) == 12 and head[3] & 4 else b""
        self.length = member_length(extra)
        raw.seek(self.start)
        self.engine, self.kept = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self.engine.eof:
            return False
        data = self.engine.unconsumed_tail
        if not data:
            left = CHUNK if self.length is None else min(CHUNK, self.start + self.length - self.raw.tell())
            data = self.raw.read(left) if left > 0 else b""
            if not data:
                return False
        self.kept += self.engine.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.kept.find(mark)) < 0:
            if not self._more():
                return b""
        out, self.kept = self.kept[: at + len(mark)], self.kept[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while True:
            parts.append(self.kept[: n - have])
            have += len(parts[-1])
            self.kept = self.kept[len(parts[-1]) :]
            if have == n:
                return b"".join(parts)
            if not self._more() and not self.kept:
                raise EOFError("the archive ends inside a record")

    def finish(self) -> None:
        """Moves the file to the next member."""
        if self.length is not None:
            self.raw.seek(self.start + self.length)
            return
        while not self.engine.eof:
            self.kept = b""
            if not self._more():
                return
        self.raw.seek(self.raw.tell() - len(self.engine.unused_data))


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith(HTTP) and (at := block.find(b"\r\n\r\n")) >= 0:
        return block[at + 4 :]
    return block


def records(raw, compressed: bool, accepts, wanted: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Accepted records of an open file as (headers, payload); the payload is None unless wanted."""
    size = raw.size()
    plain = _Plain(raw)
    while True:
        if compressed:
            if raw.tell() >= size:
                return
            source = _Inflated(raw)
        else:
            source = plain
        head = source.until(b"\r\n\r\n")
        if not head:
            return
        headers = _headers(head.lstrip())
        length = int(headers.get("content-length", 0))
        if accepts(headers):
            yield headers, _payload(headers, source.take(length)) if wanted else None
        elif not compressed:
            source.skip(length)
        if compressed:
            source.finish()
        else:
            if not wanted and accepts(headers):
                source.skip(length)
            source.skip(4)


def member(data: bytes) -> bytes:
    """One gzip member that states its own length."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A response or revisit record. The block is an HTTP head and, for a response, the payload."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1"]
    for name, value in (
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Date", row["date"]), ("WARC-Payload-Digest", row["header_digest"]), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["record_type"] == "revisit" else None),
        ("Content-Type", f"{HTTP}; msgtype=response"), ("Content-Length", str(len(block))),
    ):
        if value is not None:
            lines.append(f"{name}: {' '.join(value.split())}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.max_file_bytes = int(options.get("max_file_bytes", 256 << 20))
        self.compress = options.get("compress", "true").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        task, names, out, size = uuid.uuid4().hex, [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.max_file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{task}-{len(names):05d}.warc" + ".gz" * self.compress)
                    out, size = system.open_output_stream(posixpath.join(root, f".{names[-1]}.tmp"), compression=None), 0
                data = record_bytes(row)
                data = member(data) if self.compress else data
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(posixpath.join(root, f".{name}.tmp"), posixpath.join(root, name))

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(posixpath.join(root, f".{name}.tmp"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: str = "full", **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(payload=payload, **options).load(path)


def page_records(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """One record per page: responses with their payload, revisits with the record they refer to."""
    rows = numbered(pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")), "uid")
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    first = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min(F.struct(order.alias("order"), "uid")).alias("first"))
    )
    name = lambda page, uid: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), uid, F.lit(">"))
    again = F.col("first").isNotNull() & (F.col("first.uid") != F.col("uid"))
    first = stage(first, "first")
    return rows.join(first, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id"), F.col("uid")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(again, name(F.col("first.order.page_id"), F.col("first.uid"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("header_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, min_revisit_bytes: int = 100, **options: str) -> None:
    """Row numbers must not change between the two branches of ``page_records``: pages are read from stored files."""
    register(pages.sparkSession)
    records_of = page_records(pages, min_revisit_bytes)
    records_of.write.format(FORMAT).mode("append").options(**options).save(path)


def page_id_of(record_id: Column) -> Column:
    return F.nullif(F.element_at(F.split(record_id, ":"), 3), F.lit("none")).cast("bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page, reads the archives back; a revisit takes length and digest from its response."""
    path = new_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    read = stage(
        read_warc(spark, path, "digest").select("record_type", "record_id", "refers_to", "payload_bytes", "payload_sha256"), "records"
    )
    responses = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_sha256")
    revisits = read.where("record_type = 'revisit'").select("record_type", "record_id", "refers_to").join(responses, "refers_to", "left")
    result = read.where("record_type <> 'revisit'").unionByName(revisits)
    return result.select(
        page_id_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"),
        "record_type",
        page_id_of(F.col("refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
