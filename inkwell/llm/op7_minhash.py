"""Near duplicates by min-max hashing, with exact links.

Words are runs without white space, lower-cased for A-Z; a document's set holds its distinct five-word shingles (one
shingle of all words if there are fewer). Under each of 64 permutations both the smallest and the largest value are
kept, so 128 signature values cost 64 hash evaluations; each agrees with probability J. They form 32 bands of 4.

1. Documents with equal sets become one class, so groups of copies are one node from here on.
2. In every bucket of a band each class is paired with one hub, drawn by hash. Pairs that size and a sketch of
   four bits per signature value do not rule out are confirmed on their full sets, and the links are joined to components.
3. Buckets that still hold several components are searched across components. Buckets of up to ``SMALL`` classes are
   paired and confirmed as before. Larger ones that share classes form a group; a group is cut into blocks of about
   ``BLOCK`` classes, and one task per pair of blocks counts all shared shingles in a matrix product and returns at
   most one link per pair of components. Together these consider every pair of a bucket unless it is already
   connected, so no bucket is capped and no link between different texts of a bucket is lost. A pair with J = 0.75 shares no bucket with probability 5e-6
   (4e-8 for 0.8), and the sketch rejects it with probability below 1e-5.

Defined results: a document without words has an empty set, no links and is its own component; null identifiers are
never the smallest; repeated rows are copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import bounded, numbered, stage, table
from inkwell.llm.components import components

SHINGLE = 5
PERMUTATIONS = 64
BAND_ROWS = 4
SKETCH_WORDS = 8
SKETCH_LIMIT = 52
SMALL = 64
BLOCK = 256
COLUMNS = 8192
CACHE_WORDS = 1_000_000

_random = np.random.default_rng(7)
POSITION = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIERS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHORT = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hashes of the words seen so far; emptied when it has grown to its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    words = (text or b"").lower().split()
    n = len(words)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n == 0:
        return values
    if n < SHINGLE:
        return _mixed((values * POSITION[:n]).sum(dtype=np.uint64, keepdims=True) + SHORT[n : n + 1])
    total = values[: n - SHINGLE + 1] * POSITION[0]
    for i in range(1, SHINGLE):
        total += values[i : n - SHINGLE + 1 + i] * POSITION[i]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation: 64 minima, then 64 maxima."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 16384):
        values = MULTIPLIERS[:, None] * shingles[None, at : at + 16384]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


BANDS = 2 * PERMUTATIONS // BAND_ROWS
_BAND_WEIGHTS = _random.integers(0, 2**63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALTS = _random.integers(0, 2**63, BANDS, dtype=np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = _mixed(values).reshape(BANDS, BAND_ROWS)
    return _mixed((rows * _BAND_WEIGHTS).sum(axis=1, dtype=np.uint64) + _BAND_SALTS).view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Four bits of each signature value, in SKETCH_WORDS words."""
    bits = (_mixed(values) & np.uint64(15)).astype(np.uint8)
    return (bits[0::2] | (bits[1::2] << 4)).view(np.int64)


SIGNED = "uid bigint, {id} n bigint, digest binary, sketch array<bigint>, bands array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        size, digests = [], []
        sketches = np.zeros((batch.num_rows, SKETCH_WORDS), np.int64)
        keys, offsets = [], [0]
        for i in range(batch.num_rows):
            shingles = shingle_set(texts[i].as_py(), hashes)
            size.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            if len(shingles):
                values = signature(shingles)
                sketches[i] = sketch(values)
                keys.append(band_keys(values))
            offsets.append(offsets[-1] + (BANDS if len(shingles) else 0))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        arrays = [batch.column("uid"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digests, pa.binary())]
        places = pa.array(np.arange(0, sketches.size + 1, SKETCH_WORDS), pa.int32())
        arrays += [pa.ListArray.from_arrays(places, pa.array(sketches.ravel())), bands]
        yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "n", "digest", "sketch", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        sets = [shingle_set(texts[i].as_py(), hashes).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sets, pa.binary())], ["uid", "shingles"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            ok = [
                linked(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent)
                for i in range(batch.num_rows)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return confirm


NIBBLES = 0x1111111111111111


def _plausible(percent: int):
    """Pairs that neither the sizes nor the sketches rule out."""
    sizes = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    distance = F.lit(0)
    for i in range(SKETCH_WORDS):
        x = F.get("a.sketch", F.lit(i)).bitwiseXOR(F.get("b.sketch", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        distance = distance + F.bit_count(x.bitwiseAND(F.lit(NIBBLES)))
    return sizes & (distance <= SKETCH_LIMIT)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold."""
    some = pairs.join(sets.select(F.col("uid").alias("v"), F.col("shingles").alias("right")), "v")
    both = some.join(sets.select(F.col("uid").alias("u"), F.col("shingles").alias("left")), "u").select("u", "v", "left", "right")
    return stage(both.mapInArrow(_confirm(percent), "u bigint, v bigint"), "links")


def _star(rows: DataFrame) -> DataFrame:
    """Pairs (u, v), u larger, of every row with its bucket's hub unless both are connected already."""
    drawn = rows.withColumn("draw", F.xxhash64("node", "key"))
    hubs = stage(drawn.groupBy("key").agg(F.min("draw").alias("draw")), "draws")
    hubs = stage(drawn.join(hubs, ["key", "draw"]).select("key", F.col("node").alias("hub"), F.col("part").alias("hub_part")), "hubs")
    pairs = rows.join(hubs, "key").where("part <> hub_part")
    return pairs.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches leave."""
    some = pairs.join(sketches.alias("a"), F.col("u") == F.col("a.node")).join(sketches.alias("b"), F.col("v") == F.col("b.node"))
    return stage(some.where(_plausible(percent)).select("u", "v"), "pairs")


def _mixed_buckets(placed: DataFrame) -> DataFrame:
    """Rows (key, node, part, main, m) of the buckets with more than one component; main is the largest, m their size."""
    placed = stage(placed, "placed")
    tally = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    most = F.max(F.struct("m", "part")).alias("most")
    mixed = tally.groupBy("key").agg(most, F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m")).where("parts > 1")
    return stage(placed.join(stage(mixed.select("key", F.col("most.part").alias("main"), "m"), "mixed"), "key"), "mixed-rows")


def _products(percent: int):
    """Links between different components of two blocks, from one matrix of shared shingle counts."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node").drop_duplicates("node")
        sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = np.flatnonzero(count > 1)
        place = np.full(len(count), -1, np.int64)
        place[often] = np.arange(len(often))
        column = place[column]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(often), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            matrix = np.zeros((len(sets), min(COLUMNS, len(often) - at)), np.float32)
            matrix[owner[lo:hi], column[lo:hi] - at] = 1
            shared += matrix @ matrix.T
        part, node = rows["part"].to_numpy(), rows["node"].to_numpy()
        union = sizes[:, None] + sizes[None, :] - shared
        i, j = np.nonzero(np.triu((100 * shared >= percent * union) & (part[:, None] != part[None, :])))
        found = pd.DataFrame({"u": np.maximum(node[i], node[j]), "v": np.minimum(node[i], node[j])})
        found["a"], found["b"] = np.maximum(part[i], part[j]), np.minimum(part[i], part[j])
        return found.drop_duplicates(["a", "b"])[["u", "v"]]

    return links


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in large buckets, by pairs of blocks."""
    first = rows.groupBy("key").agg(F.min("node").alias("first"))
    edges = rows.select("key", "node").join(stage(first, "first"), "key").select(F.col("node").alias("u"), F.col("first").alias("v"))
    group = stage(components(edges), "large")
    sizes = stage(group.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes")
    member = group.join(sizes, "component").join(rows.select("node", "part").distinct(), "node")
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    spread = stage(member.select("component", "node", "part", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")), "spread")
    filled = spread.join(sets.select(F.col("uid").alias("node"), "shingles"), "node")
    return stage(filled.groupBy("component", "x", "y").applyInPandas(_products(percent), "u bigint, v bigint"), "links")


def near_duplicates(docs: DataFrame, percent: int = 75, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Returns the numbered rows (uid, row) and one decision per row: uid, doc_id, n, component_id, keep_uid.

    Links have 100 * intersection >= ``percent`` * union. ``percent`` below 75 would need more and narrower bands.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = stage(numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "uid"), "rows")
    texts = source.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    signed = stage(texts.mapInArrow(_sign, SIGNED.format(id=f"doc_id {kind},")), "signed")

    key = ["n", "digest"]
    classes = stage(signed.where("n > 0").groupBy(*key).agg(F.min("uid").alias("node")), "classes")
    member = stage(signed.where("n > 0").select("uid", "doc_id", *key).join(classes, key).select("uid", "doc_id", "node"), "members")
    nodes = signed.join(classes.select(F.col("node").alias("uid")), "uid").select(F.col("uid").alias("node"), "n", "sketch", "bands")
    in_band = stage(nodes.select("node", F.explode("bands").alias("key")), "bands")
    buckets = stage(in_band.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "buckets")
    shared = stage(in_band.join(buckets, "key"), "shared")
    involved = stage(shared.select(F.col("node").alias("uid")).distinct(), "involved")
    near = texts.select("uid", "text").join(bounded(involved, broadcast_rows), "uid")
    sets = stage(near.mapInArrow(_sets, "uid bigint, shingles binary"), "sets")
    sketches = stage(nodes.select("node", "n", "sketch").join(involved.select(F.col("uid").alias("node")), "node"), "sketches")

    pairs = stage(_star(shared.withColumn("part", F.col("node"))), "star")
    links = _links(_sketched(pairs, sketches, percent), sets, percent)
    part = stage(components(links), "components")
    rows = _mixed_buckets(shared.join(part, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")))

    open_rows = stage(rows.where(F.col("m") <= SMALL).join(sketches, "node"), "open")
    few, every = open_rows.where("part <> main").alias("a"), open_rows.alias("b")
    apart = (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    crossing = few.join(every, (F.col("a.key") == F.col("b.key")) & apart & _plausible(percent))
    crossing = crossing.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
    second = _links(stage(crossing.join(pairs, ["u", "v"], "left_anti"), "pairs"), sets, percent)
    second = second.union(_block_links(rows.where(F.col("m") > SMALL), sets, percent))

    whole = components(part.select(F.col("node").alias("u"), F.col("component").alias("v")).union(second))
    of_node = stage(
        member.join(stage(whole, "components"), "node", "left").select("uid", "doc_id", F.coalesce("component", "node").alias("component")), "of"
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    smallest = stage(of_node.groupBy("component").agg(F.min(order).alias("least")), "smallest")
    grouped = of_node.join(smallest, "component").select("uid", F.col("least.doc_id").alias("least_id"), F.col("least.uid").alias("least_uid"))
    grouped = grouped.withColumn("grouped", F.lit(True))
    decisions = signed.select("uid", "doc_id", "n").join(grouped, "uid", "left").select(
        "uid", "doc_id", "n",
        F.when(F.col("grouped"), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("least_uid", "uid").alias("keep_uid"),
    )
    return source, decisions


def deduplicated(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns."""
    rows, decisions = near_duplicates(docs, broadcast_rows=broadcast_rows)
    dropped = stage(decisions.where("uid <> keep_uid").select("uid"), "dropped")
    return rows.join(bounded(dropped, broadcast_rows), "uid", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, decisions = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return decisions.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)
