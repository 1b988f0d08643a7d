"""Quality by the perplexity of an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on all trusted text (documents labelled as good), but for one fold in ``FOLDS`` that is held out for
the thresholds. Tasks count n-grams of the highest order; Spark adds the counts up, derives the continuation counts of
the lower orders, their counts of counts and discounts, and joins each order with its context totals and with the next
lower order: p(w|h) = (a(hw) - D(a)) / a(h.) + g(h) p(w|h'). An n-gram that was not seen backs off with g(h).

The joined counts are written in shards of at most about ``shard_rows`` n-grams to the shared folder, by the two characters
before the last, so that a position's whole back-off chain lies in one shard. Scoring passes over the documents
once per shard, holds one shard in memory, and adds the shards' log probabilities up per document; documents themselves
are never shuffled. The model grows with the trusted text; memory does not.

A document is rejected if its perplexity lies above its language's threshold. The threshold comes from quantiles of
the held-out trusted documents of that language: median + ``slack`` * (``quantile`` - median), in log perplexity. The
values of short documents are first drawn to the median by ``prior_chars`` characters of median text. A language
with fewer than ``min_held_out`` held-out documents uses the quantiles of all.

Defined results: null and empty texts have no perplexity and stay; a null language is one of its own; a document with
contradicting labels is not trusted; without trusted text everything stays; repeated rows are scored each; other columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import bounded, new_path, numbered, stage, table

ORDER = 5
FOLDS = 8
PAD = 2
SHARD_ROWS = 4_000_000
BATCH_CHARS = 1 << 20
FLUSH_GRAMS = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 pads, with digits alike; and the start of each text's pads."""
    pad = chr(PAD) * (ORDER - 1)
    joined = pad + pad.join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    lengths = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def rolling(codes: np.ndarray) -> list[np.ndarray]:
    """keys[n][i]: 64-bit key of the n characters that end at position i; the first n - 1 positions hold no key."""
    keys = [np.zeros(len(codes), np.uint64), codes + np.uint64(1)]
    for _ in range(2, ORDER + 1):
        longer = keys[1].copy()
        longer[1:] += keys[-1][:-1] * MULTIPLIER
        keys.append(longer)
    return keys


def key_of(gram: str) -> int:
    value = 0
    for c in gram:
        value = (value * int(MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def _inside(starts: np.ndarray, n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for i in range(ORDER - 1):
        mask[starts + i] = False
    return mask


def _batched(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Groups of texts of about BATCH_CHARS characters, with the index of the first."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t or "")
        size += len(group[-1])
        if size >= BATCH_CHARS:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of the highest order, added up inside the task."""
    grams: dict[int, str] = {}
    counts: dict[int, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([grams[k] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["g", "c"]
        )
        grams.clear()
        counts.clear()
        return out

    for batch in batches:
        for _, group in _batched(batch.column("text").to_pylist()):
            codes, starts = codes_of(group)
            at = np.flatnonzero(_inside(starts, len(codes)))
            unique, first, n = np.unique(rolling(codes)[ORDER][at], return_index=True, return_counts=True)
            first = at[first]
            text = "".join(map(chr, codes.tolist()))
            for key, i, c in zip(unique.tolist(), first.tolist(), n.tolist(), strict=True):
                if key in counts:
                    counts[key] += c
                else:
                    counts[key] = c
                    grams[key] = text[i - ORDER + 1 : i + 1]
            if len(counts) > FLUSH_GRAMS:
                yield flush()
    if counts:
        yield flush()


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts."""
    row = grams.agg(*[F.count_if(F.col("a") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] or 0 for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


def estimate(counted: DataFrame) -> DataFrame:
    """(g, n, p, back) for every n-gram: interpolated probability, and the weight it has as a context (or null)."""
    levels = {ORDER: counted.withColumnRenamed("c", "a")}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.substring("g", 2, n)
        levels[n] = stage(levels[n + 1].groupBy(suffix.alias("g")).agg(F.count(F.lit(1)).alias("a")), f"level{n}")
    model, lower = [], None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[n])
        grams = levels[n].withColumn("h", F.substring("g", 1, n - 1))
        less = F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        totals = grams.groupBy("h").agg(F.sum("a").alias("total"), F.sum(less).alias("freed"), F.count(F.lit(1)).alias("kinds"))
        totals = stage(totals.withColumn("back", F.col("freed") / F.col("total")), f"context{n}")
        seen = grams.join(totals, "h")
        if n == 1:
            below = F.lit(1.0) / (F.col("kinds") + 1)
            model.append(totals.select(F.lit("").alias("g"), F.lit(0).alias("n"), (F.col("back") / (F.col("kinds") + 1)).alias("p")))
        else:
            seen = seen.join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), F.substring("g", 2, n - 1) == F.col("s"))
            below = F.col("below")
        p = (F.col("a") - less) / F.col("total") + F.col("back") * below
        lower = stage(seen.select("g", F.lit(n).alias("n"), p.alias("p")), f"order{n}")
        model.append(lower)
        if n > 1:
            model[-2] = model[-2].join(totals.select(F.col("h").alias("g"), "back"), "g", "left")
    model[0] = model[0].withColumn("back", F.lit(None).cast("double"))
    model[-1] = model[-1].withColumn("back", F.lit(None).cast("double"))
    whole = model[0]
    for part in model[1:]:
        whole = whole.unionByName(part)
    return whole


def shard_of(c1: np.ndarray, c2: np.ndarray, shards: int) -> np.ndarray:
    return ((c1 * np.uint64(1_000_003) + c2) % np.uint64(shards)).astype(np.int64)


def _sharded(shards: int):
    """Assigns rows to shards: n-grams by the two characters before the last, contexts by their last two."""

    def one(pair: str) -> int:
        return (ord(pair[0]) * 1_000_003 + ord(pair[1])) % shards

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"shard": [], "key": [], "n": [], "logp": [], "logb": []}
            columns = (batch.column(c).to_pylist() for c in ("g", "n", "p", "back"))
            for g, n, p, back in zip(*columns, strict=True):
                logp = float(np.log(p))
                logb = None if back is None else float(np.log(back))
                own = [one(g[-3:-1])] if n >= 3 else range(shards)
                as_context = [one(g[-2:])] if n >= 2 else range(shards)
                key = key_of(g) - (1 << 64) * (key_of(g) >> 63)
                for s in set(own) | set(as_context if logb is not None else ()):
                    row = (s, key, n, logp if s in own else None, logb if s in as_context else None)
                    for column, value in zip(out, row, strict=True):
                        out[column].append(value)
            yield pa.RecordBatch.from_pydict(out, SHARD)

    return split


SHARD = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("logp", pa.float64()), ("logb", pa.float64())])


class _Table:
    """Open-addressing table from 64-bit keys to a value, filled and asked by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, np.nan, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.isnan(self.values[at])
            slots, owners = np.unique(at[free], return_index=True)
            chosen = left[free][owners]
            self.keys[slots], self.values[slots] = keys[chosen], values[chosen]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[owners]] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, NaN where there is none."""
        at = self._slot(keys)
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(out))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            value, same = self.values[at], self.keys[at] == keys[open_]
            out[open_] = value
            go = ~same & ~np.isnan(value)
            open_, at = open_[go], at[go]
        return out


class Shard:
    def __init__(self, rows: pa.Table, number: int, shards: int):
        self.number, self.shards = number, shards
        n, keys = rows["n"].to_numpy(), rows["key"].to_numpy().view(np.uint64)
        logp, logb = rows["logp"].to_numpy(), rows["logb"].to_numpy()
        pick = lambda i, v: _Table(keys[(n == i) & ~np.isnan(v)], v[(n == i) & ~np.isnan(v)])
        self.p = [None] + [pick(i, logp) for i in range(1, ORDER + 1)]
        self.back = [None] + [pick(i, logb) for i in range(1, ORDER)]
        self.unknown = float(logp[n == 0][0])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of this shard and the sum of their log probabilities, per text."""
        codes, starts = codes_of(texts)
        keys = rolling(codes)
        total = np.zeros(len(codes))
        mine = _inside(starts, len(codes))
        if self.shards > 1:
            mine[2:] &= shard_of(codes[:-2], codes[1:-1], self.shards) == self.number
        left = np.flatnonzero(mine)
        for n in range(ORDER, 0, -1):
            value = self.p[n].get(keys[n][left])
            hit = ~np.isnan(value)
            total[left[hit]] += value[hit]
            left = left[~hit]
            if n > 1:
                back = self.back[n - 1].get(keys[n - 1][left - 1])
                total[left] += np.nan_to_num(back, nan=0.0)
        total[left] += self.unknown
        return np.add.reduceat(mine.astype(np.int64), starts), np.add.reduceat(total, starts)


_loaded: dict[str, Shard] = {}


def load_shard(path: str, number: int, shards: int) -> Shard:
    """Reads one shard from the shared folder; a worker keeps the last one."""
    name = f"{path}/shard={number}"
    if name not in _loaded:
        _loaded.clear()
        system, root = pafs.FileSystem.from_uri(name) if "://" in name else (pafs.LocalFileSystem(), name)
        _loaded[name] = Shard(pq.read_table(root, filesystem=system, columns=["key", "n", "logp", "logb"], partitioning=None), number, shards)
    return _loaded[name]


def _scorer(path: str, number: int, shards: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = load_shard(path, number, shards)
            chars, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, group in _batched(batch.column("text").to_pylist()):
                chars[first : first + len(group)], total[first : first + len(group)] = shard.score(group)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(chars), pa.array(total)], ["uid", "chars", "total"])

    return score


def train(texts: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[str, int] | None:
    """Trains on the column ``text`` and writes the shards; returns their folder and number, or None without text."""
    counted = texts.select("text").mapInArrow(_count, "g string, c bigint").groupBy("g").agg(F.sum("c").alias("c"))
    counted = stage(counted, "grams")
    model = stage(estimate(counted), "model")
    rows = model.where("n > 0").count()
    if not rows:
        return None
    shards = -(-rows // shard_rows)
    path = new_path(texts.sparkSession, "shards")
    split = model.mapInArrow(_sharded(shards), "shard int, key bigint, n int, logp double, logb double")
    split.write.partitionBy("shard").parquet(path)
    return path, shards


def score(rows: DataFrame, path: str, shards: int) -> DataFrame:
    """(uid, chars, total): characters and log probability of every text, added up over the shards."""
    parts = [rows.select("uid", "text").mapInArrow(_scorer(path, i, shards), "uid bigint, chars bigint, total double") for i in range(shards)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("uid").agg(F.sum("chars").alias("chars"), F.sum("total").alias("total")) if shards > 1 else whole


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.99,
    slack: float = 2.0,
    prior_chars: int = 200,
    min_held_out: int = 50,
    shard_rows: int = SHARD_ROWS,
    broadcast_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """Returns the numbered rows (uid, row) and uid, doc_id, lang, chars, perplexity, threshold, kept."""
    rows = stage(numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "uid"), "rows")
    flat = rows.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.col("row.text").alias("text"))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")
    trusted = stage(flat.select("uid", "doc_id").join(stage(good, "good"), "doc_id").select("uid", fold), "trusted")
    model = train(flat.select("uid", "text").join(bounded(trusted.where("fold > 0"), broadcast_rows), "uid"), shard_rows)
    if model is None:
        nothing = F.lit(None).cast("double")
        result = flat.select("uid", "doc_id", "lang", F.lit(0).cast("bigint").alias("chars"), nothing.alias("perplexity"), nothing.alias("threshold"))
        return rows, result.withColumn("kept", F.lit(True))

    scored = stage(score(flat, *model), "scores").where("chars > 0")
    tongue = F.coalesce("lang", F.lit(""))
    known = stage(
        flat.select("uid", "doc_id", tongue.alias("tongue"), "lang").join(scored, "uid", "left").withColumn("nll", -F.col("total") / F.col("chars")),
        "known",
    )
    held = known.join(trusted.where("fold = 0").select("uid"), "uid", "left_semi").where("nll IS NOT NULL")
    held = stage(held.select(F.explode(F.array("tongue", F.lit("*"))).alias("tongue"), "chars", "nll"), "held")
    centre = stage(held.groupBy("tongue").agg(F.percentile_approx("nll", 0.5, 10000).alias("mid"), F.count(F.lit(1)).alias("docs")), "centre")
    drawn = lambda mid: (F.col("nll") * F.col("chars") + mid * prior_chars) / (F.col("chars") + prior_chars)
    spread = held.join(F.broadcast(centre), "tongue").groupBy("tongue", "mid", "docs").agg(
        F.percentile_approx(drawn(F.col("mid")), quantile, 10000).alias("high")
    )
    limits = stage(spread.select("tongue", "docs", "mid", (F.col("mid") + slack * (F.col("high") - F.col("mid"))).alias("limit")), "limits")
    own = limits.where((F.col("docs") >= min_held_out) & (F.col("tongue") != "*")).drop("docs")
    pooled = limits.where("tongue = '*'").select(F.col("mid").alias("mid0"), F.col("limit").alias("limit0"))
    result = known.join(bounded(own, 10_000), "tongue", "left").join(F.broadcast(pooled.limit(1)), how="left")
    result = result.withColumns({"mid": F.coalesce("mid", "mid0"), "limit": F.coalesce("limit", "limit0")})
    high = F.coalesce(drawn(F.col("mid")) > F.col("limit"), F.lit(False))
    return rows, result.select(
        "uid", "doc_id", "lang", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"), F.exp("nll").alias("perplexity"),
        F.exp("limit").alias("threshold"), (~high).alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    rows, result = classify(docs, labels, broadcast_rows=broadcast_rows, **options)
    rejected = stage(result.where("NOT kept").select("uid"), "rejected")
    return rows.join(bounded(rejected, broadcast_rows), "uid", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, sf_dir, "labels"))[1].drop("uid")
