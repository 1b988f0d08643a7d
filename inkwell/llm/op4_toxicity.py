"""Toxicity scores from the nearest labelled examples by TF-IDF cosine.

Learning. Labelled rows with crc32(doc_id) mod 5 <> 0 are the learning rows. Of each label at most about ``per_label`` of them,
in hash order, form a bounded sample; nine tenths are examples of the index, one tenth calibrates. Copies of one label are
counted once, so that a text posted often does not turn its rare words into evidence.

Vectors. Every word of every example is a dimension, weighed by its frequency in the text and its idf over all documents. Words
and word beginnings whose frequencies differ most between the labels (G statistic) stand beside them once more as dimensions of
their own, so that label words are not drowned by topic words. Both parts are unit vectors; the cosine of two texts is
``GENERAL`` times that of all words plus the rest times that of the label words, or that of all words alone if neither
text has a label word. The selection only adds weight: no word, example or text is left out, and a copy has cosine 1.

Index. Examples with alike features stand together in blocks of ``BLOCK``. Features of few examples are posting lists and are
added up exactly. Features of many examples have their largest weight in each block; the block maxima bound what they can
add, blocks are completed in falling order of the bound, and the search stops once the k-th best cosine is not below the next
bound. That is exact.

Scores. Each of the k neighbours votes with the square of its cosine over its distance (1 - cosine), against a prior; a logistic function of the vote,
fitted on the calibration rows, gives the score. A text without any word of an example gets the calibrated prior. Evidence
lists the best neighbours with label and cosine. Only the text enters a score.

Defined results: null and empty texts score like texts without features; repeated rows score alike; rows without
labels are scored too; contradicting labels count as toxic; without examples of both labels every score is the share
of toxic learning rows (0 without any); an empty table gives an empty result; very long texts are read whole; equal cosines keep
the order of the index; doc_ids that are no integers are no learning rows; other columns are not read. The sample bound is the
parameter ``per_label``; vocabulary, index and calibration are bounded with the texts of the sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import bounded, numbered, stage, table

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
BLOCK = 64
CACHE = 200_000
#: share of all words in a cosine; the rest belongs to the label words
GENERAL = 0.2
#: added to distances, so that a copy votes with a finite weight
NEAREST = 0.05


def features_of_word(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


def word_counts(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


@dataclass
class Space:
    """Dimensions: the words of the examples, then the label words and beginnings; with their idf."""

    words: dict[str, int]
    marks: dict[str, int]
    idf: np.ndarray


class _Known(dict):
    """word -> number of its own dimension, -1 without any dimension, -2 - n if it also has label dimensions: ``several[n]`` lists all.

    Words without a dimension are not kept; most words of a large corpus are such, and would displace the others.
    """

    def __init__(self, space: Space):
        super().__init__()
        self.space = space
        self.begins = [(n, {f[:-1]: i for f, i in space.marks.items() if f.endswith("*") and len(f) == n + 1}) for n in PREFIXES]
        self.several: list[tuple[int, ...]] = []

    def __missing__(self, word: str) -> int:
        own, mark = self.space.words.get(word), self.space.marks.get(word)
        marks = [m for m in (mark, *[numbers.get(word[:n]) for n, numbers in self.begins if len(word) > n]) if m is not None]
        if not marks and own is None:
            return -1
        if not marks:
            found = own
        else:
            found = -2 - len(self.several)
            self.several.append(tuple(marks) if own is None else (own, *marks))
        self[word] = found
        return found


def vector(text: str | None, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector over the space: numbers of the dimensions in rising order, and weights; empty without features."""
    counts = word_counts(text)
    if len(known) >= CACHE:  # emptied between texts: a text's codes must stay valid while it is read
        known.clear()
        known.several.clear()
    codes = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    single = codes >= 0
    more: dict[int, int] = {}
    for code, n in zip(codes[codes < -1].tolist(), tf[codes < -1].tolist(), strict=True):
        for f in known.several[-2 - code]:
            more[f] = more.get(f, 0) + n
    ids = np.concatenate([codes[single], np.fromiter(more.keys(), np.int64, len(more))])
    raw = (1 + np.log(np.concatenate([tf[single], np.fromiter(more.values(), np.int64, len(more))]).astype(float))) * known.space.idf[ids]
    order = np.argsort(ids)
    ids, raw = ids[order], raw[order]
    cut = np.searchsorted(ids, len(known.space.words))
    parts = [raw[:cut] / max(np.linalg.norm(raw[:cut]), 1e-300), raw[cut:] / max(np.linalg.norm(raw[cut:]), 1e-300)]
    if 0 < cut < len(ids):
        parts = [parts[0] * math.sqrt(GENERAL), parts[1] * math.sqrt(1 - GENERAL)]
    return ids, np.concatenate(parts)


class BlockMaxIndex:
    """Exact nearest neighbours by cosine over sparse unit vectors."""

    def __init__(self, vectors: list[tuple], features: int, common: float = 1 / 4):
        order = sorted(range(len(vectors)), key=lambda i: sorted(zip(vectors[i][1], vectors[i][0], strict=True), reverse=True)[:3])
        self.order = np.array(order, np.int64)
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        sizes = [len(vectors[i][0]) for i in order]
        every = np.concatenate([np.asarray(vectors[i][0], np.int64) for i in order] or [np.zeros(0, np.int64)])
        weights = np.concatenate([np.asarray(vectors[i][1], float) for i in order] or [np.zeros(0)])
        places = np.repeat(np.arange(self.n), sizes)
        held = np.bincount(every, minlength=features)
        often = np.flatnonzero(held > max(1, common * self.n))
        self.row = np.full(features, -1, np.int64)  # row of a common feature in ``dense``
        self.row[often] = np.arange(len(often))
        # A block's weights stand together: completing a block reads whole rows of it.
        self.dense = np.zeros((self.blocks, len(often), BLOCK))
        wide = self.row[every] >= 0
        self.dense[places[wide] // BLOCK, self.row[every[wide]], places[wide] % BLOCK] = weights[wide]
        self.bounds = self.dense.max(axis=2).T.copy()
        by = np.argsort(every[~wide], kind="stable")
        self.places, self.weights = places[~wide][by], weights[~wide][by]
        self.starts = np.searchsorted(every[~wide][by], np.arange(features + 1))

    def nearest(self, ids, weights, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest vectors with a positive cosine; equal cosines in index order."""
        ids, weights = np.asarray(ids, np.int64), np.asarray(weights, float)
        row = self.row[ids]
        few = row < 0
        starts, ends = self.starts[ids[few]], self.starts[ids[few] + 1]
        size = ends - starts
        at = np.arange(size.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else starts, size)
        score = np.bincount(self.places[at], self.weights[at] * np.repeat(weights[few], size), self.blocks * BLOCK)
        rows, heavy = row[~few], weights[~few]
        upper = score.reshape(self.blocks, BLOCK).max(axis=1) + heavy @ self.bounds[rows] + 1e-12
        falling = np.argsort(-upper, kind="stable")
        places, cosines, worst = np.zeros(0, np.int64), np.zeros(0), 0.0
        for first in range(0, self.blocks, 8):
            some = falling[first : first + 8]
            some = some[upper[some] >= (worst if len(cosines) == k else 2e-12)]
            if not len(some):
                break
            here = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            exact = score[here] + (heavy @ self.dense[some[:, None], rows]).ravel()
            hit = exact >= worst if worst else exact > 0
            places, cosines = np.concatenate([places, here[hit]]), np.concatenate([cosines, exact[hit]])
            best = np.lexsort((places, -cosines))[:k]
            places, cosines = places[best], cosines[best]
            worst = cosines[-1] if len(cosines) == k else 0.0
        return self.order[places], cosines


@dataclass
class Model:
    space: Space
    index: BlockMaxIndex | None
    example_ids: list[int | None]
    labels: np.ndarray
    prior: float
    k: int
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, ids: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of the neighbours' votes, the neighbours and their cosines."""
        near, cosines = self.index.nearest(ids, weights, self.k) if len(ids) and self.index else (np.zeros(0, np.int64), np.zeros(0))
        strength = cosines**2 / (1 - np.minimum(cosines, 1.0) + NEAREST)
        share = (float(strength @ self.labels[near]) + self.prior) / (float(strength.sum()) + 1)
        share = min(max(share, 1e-4), 1 - 1e-4)
        return math.log(share / (1 - share)), near, cosines

    def probability(self, odds: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * odds + self.shift, -40.0), 40.0)))


def _fit(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by Newton steps on softened labels, the slope kept positive."""
    slope, shift = 1.0, 0.0
    soft = np.where(labels == 1, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * odds + shift, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - soft) * odds).sum() + 0.01 * (slope - 1), (p - soft).sum()])
        h = np.array([[(w * odds * odds).sum() + 0.01, (w * odds).sum()], [(w * odds).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))  # separable rows must not send a step off
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(slope), 0.05), float(shift)


def _shingle_minima(text: str) -> list[int]:
    """Three minima of independent hashes over five-word shingles: near copies share most of them."""
    words = text.lower().split()
    grams = [" ".join(words[i : i + 5]).encode() for i in range(max(1, len(words) - 4))]
    crc = np.array([zlib.crc32(g) for g in grams], np.uint64)
    return [int(((crc * m + a) % np.uint64(4294967291)).min()) for m, a in ((3266489917, 11), (2246822519, 13), (668265263, 17))]


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        minima = [_shingle_minima(t or "") for t in batch.column("text").to_pylist()]
        arrays = [*(batch.column(c) for c in ("uid", "doc_id", "toxic", "place")), pa.array(minima, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "toxic", "place", "minima"])


def _distinct(rows: list) -> list:
    """Of rows with one label and the same minima, the first; of repeated ids, too."""
    texts: set = set()
    ids: set = set()
    kept = []
    for row in rows:
        key = (row["toxic"], *row["minima"])
        if key not in texts and row["doc_id"] not in ids:
            kept.append(row)
        texts.add(key)
        ids.add(row["doc_id"])
    return kept


def sample_ids(labels: DataFrame, per_label: int) -> DataFrame:
    """At most about ``per_label`` learning ids of each label, by hash."""
    marked = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    marked = stage(marked.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "learning")
    place = (F.xxhash64("doc_id") / F.lit(2.0**64)) + 0.5
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, per_label / max(per_label, counts.get(1, 0))).otherwise(per_label / max(per_label, counts.get(0, 0)))
    return marked.where(place < share).select("doc_id", "toxic", F.lit(counts.get(1, 0) / max(1, sum(counts.values()))).alias("base"))


def _select_features(kept: DataFrame, totals: tuple[int, int], size: int, least: int, least_g: float = 15.0, ratio: float = 3.0) -> list[tuple[str, int]]:
    """The label words: those whose document frequency differs most between the labels, with their document frequency.

    The frequencies must differ ``ratio`` times. They only get a second weight; no other word loses its own.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {f for w in word_counts(text) for f in features_of_word(w)}
                words += found
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])

    counts = (
        kept.select("text", "toxic").mapInArrow(explode, "feature string, toxic int").groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where(F.greatest("a", "b") >= least)
    )
    n1, n0 = (float(n) for n in totals)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    seen = a + b
    g = (
        part(a, seen * n1 / (n1 + n0)) + part(b, seen * n0 / (n1 + n0))
        + part(n1 - a, (n1 + n0 - seen) * n1 / (n1 + n0)) + part(n0 - b, (n1 + n0 - seen) * n0 / (n1 + n0))
    )
    high, low = F.greatest(a / n1, b / n0), F.least(a / n1, b / n0)
    counts = counts.where(high >= ratio * low)
    best = counts.select("feature", seen.alias("df"), (2 * g).alias("g")).where(F.col("g") > least_g).orderBy(F.col("g").desc(), "feature").limit(size)
    return [(r["feature"], int(r["df"])) for r in best.collect()]


def document_counts(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the given words occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts, rows = shared.value, np.zeros(len(words), np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = [number[w] for w in set(WORDS.findall((text or "").lower())) if w in number]
                counts[found] += 1
                rows += 1
        at = np.flatnonzero(counts)
        ids, n = np.append(at, -1), np.append(counts[at], rows)  # -1 counts the documents
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    out, total = np.zeros(len(words), np.int64), 0
    for r in docs.select("text").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        if r["id"] < 0:
            total = r["n"]
        else:
            out[r["id"]] = r["n"]
    return out, total


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 1500, k: int = 25, size: int = 600) -> Model:
    """Fits the model on the bounded sample. Texts stay in Spark; the driver gets minima, words and sparse vectors of the sample."""
    spark = docs.sparkSession
    ids = stage(sample_ids(labels, per_label), "sample")
    place = F.xxhash64("doc_id", "text").alias("place")
    texts = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), "text").join(bounded(ids, 4 * per_label), "doc_id")
    texts = stage(numbered(texts.select("doc_id", "text", "toxic", "base", place), "uid"), "sample-texts")
    first = texts.select("base").first()
    prior = first["base"] if first else 0.0
    signed = texts.select("uid", "doc_id", "toxic", "place", "text").mapInArrow(
        _minima, "uid bigint, doc_id bigint, toxic int, place bigint, minima array<bigint>"
    )
    kept = _distinct(sorted(signed.collect(), key=lambda r: (r["place"], r["doc_id"])))
    tune, examples = [r for i, r in enumerate(kept) if i % 10 == 0], [r for i, r in enumerate(kept) if i % 10]
    totals = sum(r["toxic"] for r in examples), sum(1 - r["toxic"] for r in examples)
    if not min(totals):
        return Model(Space({}, {}, np.zeros(0)), None, [], np.zeros(0), prior, k)
    chosen_rows = spark.createDataFrame([(r["uid"],) for r in examples], "uid bigint")
    own = stage(texts.join(F.broadcast(chosen_rows), "uid"), "examples")
    chosen = _select_features(own, totals, size, max(4, math.ceil(0.004 * min(totals))))
    words = [r["word"] for r in own.select("text").mapInArrow(_words, "word string").distinct().orderBy("word").collect()]
    counts, documents = document_counts(docs, words)
    idf = np.concatenate([np.log(1 + documents / np.maximum(counts, 1)), [math.log(1 + len(examples) / df) for _, df in chosen]])
    space = Space({w: i for i, w in enumerate(words)}, {f: len(words) + i for i, (f, _) in enumerate(chosen)}, idf)
    vectors = {r["uid"]: (r["ids"], r["weights"]) for r in _vectors(texts, space).collect()}
    index = BlockMaxIndex([vectors[r["uid"]] for r in examples], len(idf))
    model = Model(space, index, [r["doc_id"] for r in examples], np.array([r["toxic"] for r in examples], float), prior, k)
    odds = np.array([model.vote(*vectors[r["uid"]])[0] for r in tune])
    truth = np.array([r["toxic"] for r in tune], float)
    if 0 < truth.sum() < len(truth):
        model.slope, model.shift = _fit(odds, truth)
    return model


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column("text").to_pylist() for w in word_counts(t)}), pa.string())], ["word"])


def _vectors(texts: DataFrame, space: Space) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in batches:
            found = [vector(t, known) for t in batch.column("text").to_pylist()]
            ids, weights = [v[0] for v in found], [v[1] for v in found]
            arrays = [batch.column("uid"), pa.array(ids, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "ids", "weights"])

    return texts.select("uid", "text").mapInArrow(run, "uid bigint, ids array<bigint>, weights array<double>")


EVIDENCE = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])


def toxicity(docs: DataFrame, model: Model, shown: int = 3) -> DataFrame:
    """doc_id, score and evidence (doc_id, toxic, cosine of the nearest examples) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Known(model.space)
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column("text"):
                odds, near, cosines = model.vote(*vector(text.as_py(), known))
                scores.append(model.probability(odds) if model.index else model.prior)
                evidence.append(
                    [
                        {"doc_id": model.example_ids[i], "toxic": int(model.labels[i]), "cosine": round(float(c), 6)}
                        for i, c in zip(near[:shown], cosines[:shown], strict=True)
                    ]
                )
            arrays = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(EVIDENCE))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity(docs, model)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )
