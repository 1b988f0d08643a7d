"""Language identification with error-correcting output codes.

Every learned language has a codeword. For each bit a binary classifier (logistic regression over hashed letter n-grams) tells
the languages with a one from those with a zero. Decoding sums, over the bits, the logistic loss of the classifier's margin
under a language's code bit, weighted by how much better than chance the classifier did on texts held back from its training;
the language with the least sum is the nearest codeword. If the second one comes within ``ambiguous_below`` the row
is flagged.

Codes. K languages have at most 2^(K-1) - 1 different splits in two; all of them are used up to a length of about
15 log2 K, beyond it the rows of a fixed pseudo-random sequence with the largest least distance of codewords. With four languages
that is the complete code of seven bits. The model grows with the number of different language values, nothing else.

Learning. Rows with a language and crc32(doc_id) mod 5 <> 0 are the learning rows. About ``SAMPLE`` of their distinct texts, the same
number per language by hash order, give the features of the whole text and of a short window of it (for short inputs); three
quarters train, one quarter weighs the bits. The sample is the only part whose size is bounded; Spark counts languages over all learning
rows, extracts features in tasks, and fits the bits in parallel tasks. Every text of the table is scored whole, by slices.

Defined results: a text that is null or has no letter is ``und`` with score 0; without learning rows everything is; with a single
learned language every text with a letter is that language with score 1. Null doc_ids count as empty text for the fold. Repeated
rows are scored alike; repeated learning texts count once per language. Ties go to the smaller language value. lang, source and doc_id
are never inputs of a score. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import stage, table

SAMPLE = 2400
BUCKETS = 4096
SLICE = 1 << 18
WINDOW = 48
#: multipliers of the n-gram hash (odd, so that no bits are lost)
MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))

_letters: list[np.ndarray] = []


# ------------------------------------------------------------------------------------------------ features


def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, 32 for what is no letter; made once per worker."""
    if not _letters:
        chars = np.arange(0x110000, dtype=np.uint32)
        known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        lower = chars.copy()
        for c in np.flatnonzero(known):
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
        lower[~known] = 32
        _letters.append(lower)
    return _letters[0]


def gram_counts(text: str, size: int = SLICE) -> np.ndarray | None:
    """Hashed counts of letter 1-, 2- and 3-grams of the whole text, with one space between words; None without a letter.

    The text is read in slices of ``size`` code points; the last two characters of a slice start the next one.
    """
    lower, counts, tail = _lower_letters(), np.zeros(BUCKETS), np.full(1, 32, np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    any_letter = False
    for k in range(0, len(text), size):
        raw = np.frombuffer(text[k : k + size].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.concatenate([tail, lower[raw]])
        if k + size >= len(text):
            own = np.append(own, np.uint32(32))
        blank = own == 32
        keep = np.ones(len(own), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        any_letter = any_letter or not blank.all()
        own = own[keep]
        mixed = own * MIX[0]
        for n, grams in ((1, own), (2, mixed[:-1] + own[1:] * MIX[1]), (3, mixed[:-2] + own[1:-1] * MIX[1] + own[2:] * MIX[2])):
            new = grams[max(0, len(tail) - n + 1) :]  # grams that end within the tail are counted already
            if n == 1:
                new = new[new != 32]
            hashed = ((new ^ (new >> np.uint32(15))) * MIX[3] + np.uint32(n)) * MIX[0]
            counts += np.bincount(hashed >> shift, minlength=BUCKETS)
        tail = own[-2:]
    return counts if any_letter else None


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, as a vector of unit length."""
    root = np.sqrt(counts)
    return (root / max(float(np.linalg.norm(root)), 1e-12)).astype(np.float32)


def window(text: str) -> str:
    """A short piece from the middle of the text, for learning what short texts look like."""
    start = max(0, len(text) // 2 - WINDOW // 2)
    return text[start : start + WINDOW]


# ------------------------------------------------------------------------------------------------ code and model


def codewords(k: int) -> np.ndarray:
    """(languages, bits) of zeros and ones; no two columns make the same split and no two rows are equal."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    wanted = max(7, 15 * math.ceil(math.log2(k)))
    if 2 ** (k - 1) - 1 <= wanted:
        splits = itertools.product((0, 1), repeat=k - 1)
        return np.array([(1, *s) for s in splits if not all(s)], np.int8).T
    best, rng = None, random.Random(k)
    for _ in range(50):
        columns: set[tuple[int, ...]] = set()
        while len(columns) < wanted:
            column = tuple(rng.randrange(2) for _ in range(k))
            if 0 < sum(column) < k:
                columns.add(column if column[0] else tuple(1 - b for b in column))
        code = np.array(sorted(columns), np.int8).T
        signs = 2.0 * code - 1
        least = (wanted - np.max(signs @ signs.T - 2 * wanted * np.eye(k))) / 2
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets + 1 (bias) x bits
    trust: np.ndarray  # one weight per bit
    ambiguous_below: float

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights[:-1] + self.weights[-1]

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """Rows of one share per language from the trusted losses of the bits."""
        signs = 2.0 * self.code - 1
        loss = np.logaddexp(0, -margins[:, None, :] * signs[None]) @ self.trust
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return share / share.sum(axis=1, keepdims=True)


def fit_bit(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 200, decay: float = 1e-5) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient steps; the last weight is the bias."""
    theta = np.zeros(x.shape[1] + 1)
    speed, rate = np.zeros_like(theta), 4.0 / (1.0 + decay)  # rows have unit length: the curvature is at most 1/4 for each part
    share = w / max(w.sum(), 1e-12)
    for k in range(steps):
        ahead = theta + k / (k + 3) * speed
        miss = share * (1 / (1 + np.exp(-np.clip(x @ ahead[:-1].astype(np.float32) + ahead[-1], -40, 40))) - y)
        grad = np.append(miss.astype(np.float32) @ x, miss.sum()) + decay * ahead
        now = ahead - rate / 2 * grad
        theta, speed = now, now - theta
    return theta


# ------------------------------------------------------------------------------------------------ learning


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, rows = batch.column(0).to_pylist(), []
        for lang, text in zip(langs, batch.column(1), strict=True):
            text = text.as_py()
            for whole, part in ((True, text), (False, window(text))):
                counts = gram_counts(part)
                if counts is not None:
                    rows.append((lang, whole, scaled(counts).astype(np.float16).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())],
            ["lang", "whole", "vector"],
        )


def learning_sample(docs: DataFrame, sample: int) -> tuple[list[str], list]:
    """Languages of all learning rows, and the features of about ``sample`` distinct texts, equally many per language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    texts = stage(rows.select("lang", F.xxhash64("lang", "text").alias("h")).distinct(), "texts")
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    each = max(1, sample // max(1, len(counts)))
    limit = lambda n: int(2**63 * min(1.0, each / n) * 2) - 2**63 - 1
    limits = docs.sparkSession.createDataFrame([(lang, limit(n)) for lang, n in counts.items()], "lang string, most bigint")
    chosen = (
        rows.withColumn("h", F.xxhash64("lang", "text")).join(F.broadcast(limits), "lang").where("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text"))
    )
    found = chosen.select("lang", "text").mapInArrow(_features, "lang string, whole boolean, vector binary")
    # a language's share exceeds its mean by little: the bound below is never met by hash order, it only guards the driver
    return list(counts), found.orderBy(F.xxhash64("vector", "lang")).limit(4 * sample).collect()


def learn(docs: DataFrame, sample: int = SAMPLE, ambiguous_below: float = 0.2) -> Model:
    spark = docs.sparkSession
    languages, rows = learning_sample(docs, sample)
    code = codewords(len(languages))
    if not code.shape[1] or not rows:
        return Model(languages, code, np.zeros((BUCKETS + 1, code.shape[1])), np.zeros(code.shape[1]), ambiguous_below)
    x = np.frombuffer(b"".join(r["vector"] for r in rows), np.float16).reshape(len(rows), BUCKETS)
    number = {lang: i for i, lang in enumerate(languages)}
    of = np.array([number[r["lang"]] for r in rows])
    share = np.bincount(of, minlength=len(languages))
    part = np.arange(len(rows)) % 4  # rows come in hash order
    shared = spark.sparkContext.broadcast((x, of, share, part, code))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, of, share, part, code = shared.value
        train, w = part > 0, 1.0 / share[of]
        seen, unseen = x[train].astype(np.float32), x[~train].astype(np.float32)
        for frame in frames:
            for bit in frame["bit"]:
                y = code[of, bit].astype(float)
                # both sides of a split weigh the same
                side = np.where(y == 1, w / max(w[train & (y == 1)].sum(), 1e-12), w / max(w[train & (y == 0)].sum(), 1e-12))
                theta = fit_bit(seen, y[train], side[train])
                margin = unseen @ theta[:-1] + theta[-1]
                own = side[~train] / max(side[~train].sum(), 1e-12)
                loss = float((own * np.logaddexp(0, -margin * (2 * y[~train] - 1))).sum())
                yield pd.DataFrame({"bit": [bit], "trust": [max(0.05, 1 - loss / math.log(2))], "theta": [theta.tolist()]})

    bits = spark.createDataFrame([(b,) for b in range(code.shape[1])], "bit int").repartition(code.shape[1])
    fits = sorted(bits.mapInPandas(fit, "bit int, trust double, theta array<double>").collect(), key=lambda r: r["bit"])
    shared.unpersist()
    return Model(languages, code, np.array([r["theta"] for r in fits]).T, np.array([r["trust"] for r in fits]), ambiguous_below)


# ------------------------------------------------------------------------------------------------ scoring


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float, str | None, bool]]:
    """(language, score, second language, ambiguous) for each text."""
    grams = [None if t is None else gram_counts(t) for t in texts]
    known = [i for i, g in enumerate(grams) if g is not None]
    out: list[tuple[str, float, str | None, bool]] = [("und", 0.0, None, False)] * len(texts)
    if not known or not model.languages:
        return out
    if len(model.languages) == 1:
        for i in known:
            out[i] = (model.languages[0], 1.0, None, False)
        return out
    shares = model.shares(model.margins(np.stack([scaled(grams[i]) for i in known])))
    order = np.argsort(-shares, axis=1, kind="stable")
    for row, i in enumerate(known):
        a, b = order[row, 0], order[row, 1]
        first, second = float(shares[row, a]), float(shares[row, b])
        out[i] = (model.languages[a], first, model.languages[b], first - second < model.ambiguous_below)
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, second, ambiguous of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                found = predict(part.column("text").to_pylist(), shared.value)
                columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "second", "ambiguous"]
                )

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        run, f"doc_id {id_type.simpleString()}, held_out boolean, lang_pred string, score double, second string, ambiguous boolean"
    )


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scored(docs, learn(docs, sample))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
