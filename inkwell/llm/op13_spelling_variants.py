"""Grouping of spelling variants with K-d trees over letter-count vectors.

Words are counted over all documents: each task adds up the runs of its texts, Spark adds up the tasks. Two words are near if one
inserted, deleted or replaced code point turns one into the other. Such an edit adds one letter, removes one letter or
does both, so letter-count vectors of near words differ by at most two (L1), and the squared distance is exactly 1 (lengths differ)
or 2 (equal lengths) if and only if the vectors differ by one such edit.

Search per length pair. For every length a K-d tree splits the vectors into blocks. The upper tree is fitted on a bounded
sample of words (``SAMPLE``) and only fixes where blocks end; every word is indexed in the one block of its box. A
word is a query to the blocks of its own length and of the next one: at each split it follows its own side, and the other one if
its unused addition or removal can cross. Spark groups base words and queries by block; a block with more
rows than ``BLOCK`` (or 16 MB of letters) is cut into parts of base words and parts of queries, and every part meets every other, so
no group is unbounded and no pair is lost. Within a part a further K-d tree prunes boxes the same way down to leaves
of a few words, the vectors that remain are compared, and their letters are then verified in order.

Forms. A word's near words are counted and the one of largest n is kept in partial aggregates. Along forms n at least doubles, so
chains are shorter than log2 of the largest n and roots are found by that many steps' logarithm of pointer jumping.

Defined results: null and empty texts have no words; a null doc_id gives an empty prefix in the checksum; rows that repeat count
again; very long texts are read whole, in slices that end between runs; ties of n go to the smallest word in code-point order. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import stage, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
PLACE = np.zeros(0x100, np.int64)
PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SLICE = 1 << 20
HELD = 300_000
SAMPLE = 200_000
BLOCK = 16_384
LEAF = 24


# ------------------------------------------------------------------------------------------------ word counts


def run_slices(text: str, size: int = SLICE) -> Iterator[list[str]]:
    """The runs of letters of a text, slice by slice; no slice ends within a run."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if rest := RUN.match(text, end):
            end = rest.end()
        yield RUN.findall(text, start, end)
        start = end


def _word_counts(batches: Iterator[pa.RecordBatch], damage: int, held: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for runs in run_slices(text.as_py() or ""):
                for run, n in Counter(runs).items():
                    word = run.lower() if run.isascii() else run.translate(LOWER)
                    h = zlib.crc32(word.encode(), prefix)
                    if h % damage == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    if len(word) >= 5:
                        counts[word] += n
                if len(counts) >= held:
                    yield out()
                    counts.clear()
    if counts:
        yield out()


def vocabulary(docs: DataFrame, least: int = 3, damage: int = 97, held: int = HELD) -> DataFrame:
    """(word, n): distinct damaged words of at least five code points and ``least`` occurrences in all documents."""
    part = docs.select("doc_id", "text").mapInArrow(lambda b: _word_counts(b, damage, held), "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ------------------------------------------------------------------------------------------------ K-d trees


def codes(words: list[str], length: int) -> np.ndarray:
    """One row of letter numbers per word; all words have ``length`` code points."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return PLACE[flat].astype(np.uint8).reshape(len(words), length)


def vectors(code: np.ndarray) -> np.ndarray:
    n, width = len(code), len(LETTERS)
    cell = code.astype(np.int64) + np.arange(n)[:, None] * width
    return np.bincount(cell.ravel(), minlength=n * width).reshape(n, width).astype(np.int32)


def grown(points: np.ndarray, most: float) -> tuple | np.ndarray:
    """K-d tree: (letter, threshold, left, right) or the row numbers of a leaf of at most ``most`` rows.

    A node is split at the median of its most spread letter. Equal vectors are never split, so such a leaf may be larger.
    """

    def grow(rows: np.ndarray):
        if len(rows) <= most:
            return rows
        own = points[rows]
        spread = own.var(axis=0)
        letter = int(spread.argmax())
        if spread[letter] == 0:
            return rows
        column = own[:, letter]
        cut = int(np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2])
        if cut == column.max():
            cut -= 1
        low = column <= cut
        return letter, cut, grow(rows[low]), grow(rows[~low])

    return grow(np.arange(len(points)))


def reached(tree, points: np.ndarray, add: bool, remove: bool) -> Iterator[tuple]:
    """(leaf, rows of ``points``) for every leaf whose box is at most one added and one removed letter away."""
    n = len(points)
    stack = [(tree, np.arange(n), np.full(n, add), np.full(n, remove))]
    while stack:
        node, rows, adds, removes = stack.pop()
        if not len(rows):
            continue
        if not isinstance(node, tuple):
            yield node, rows
            continue
        letter, cut, left, right = node
        have = points[rows, letter]
        down, up = (have == cut + 1) & removes, (have == cut) & adds
        go = (have <= cut) | down
        stack.append((left, rows[go], adds[go], (removes & ~down)[go]))
        go = (have > cut) | up
        stack.append((right, rows[go], (adds & ~up)[go], removes[go]))


def _numbered(tree, first: int = 0) -> tuple:
    """The tree with leaves replaced by their numbers, and the next free number."""
    if not isinstance(tree, tuple):
        return first, first + 1
    left, after = _numbered(tree[2], first)
    right, after = _numbered(tree[3], after)
    return (tree[0], tree[1], left, right), after


def block_size(length: int, block: int) -> int:
    return max(1, min(block, (1 << 24) // length))


def fitted(words: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> dict[int, tuple | int]:
    """Upper trees by word length from at most ``sample`` words; a leaf is the number of a block."""
    total = words.count()
    rate = min(1.0, sample / max(total, 1))
    chosen = words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.ceil(rate * (1 << 20))).limit(sample)
    by_length: dict[int, list[str]] = {}
    for r in chosen.where(F.length("word") <= 4096).collect():
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    trees = {}
    for length, own in by_length.items():
        trees[length] = _numbered(grown(vectors(codes(own, length)), rate * block_size(length, block)))[0]
    return trees


# ------------------------------------------------------------------------------------------------ search

BASE, SAME, SHORTER = range(3)


def _routed(frames: Iterator[pd.DataFrame], trees: dict) -> Iterator[pd.DataFrame]:
    """Each word as a base row of one block and as a query to the blocks it can reach."""
    for frame in frames:
        for length, own in frame.groupby(frame["word"].str.len()):
            points, length = vectors(codes(own["word"].tolist(), int(length))), int(length)
            for side, at, add, remove in ((BASE, length, False, False), (SAME, length, True, True), (SHORTER, length + 1, True, False)):
                for leaf, rows in reached(trees.get(at, 0), points, add, remove):
                    found = own.iloc[rows]
                    yield pd.DataFrame({"length": at, "leaf": leaf, "side": side, "word": found["word"], "n": found["n"]})


def near_pairs(base: list[str], queries: list[str], same: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (query, base) of near words; base words have the queries' length (``same``) or one letter more."""
    none = np.empty(0, np.int64)
    if not base or not queries:
        return none, none
    length = len(base[0])
    b, q = codes(base, length), codes(queries, length - (not same))
    bv, qv = vectors(b), vectors(q)
    used = np.flatnonzero((bv.max(axis=0) > 0) | (qv.max(axis=0) > 0))
    kind = np.float32 if length < 2048 else np.float64  # squares of counts stay exact
    bv, qv = bv[:, used], qv[:, used]
    bf, qf = bv.astype(kind), qv.astype(kind)
    bs, qs = (bf * bf).sum(axis=1), (qf * qf).sum(axis=1)
    found = [(none, none)]
    for at, all_rows in reached(grown(bv, leaf), qv, True, same):
        for here in np.array_split(at, -(-len(at) // 1024)):
            step = max(1, (1 << 21) // len(here))
            for k in range(0, len(all_rows), step):
                rows = all_rows[k : k + step]
                apart = qs[rows][:, None] + bs[here] - 2 * (qf[rows] @ bf[here].T)
                i, j = np.nonzero(apart == (2 if same else 1))
                i, j = rows[i], here[j]
                for c in range(0, len(i), 1 << 18):
                    i_, j_ = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
                    ok = _in_order(q[i_], b[j_], same)
                    found.append((i_[ok], j_[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _in_order(short: np.ndarray, long: np.ndarray, same: bool) -> np.ndarray:
    """Whether one replacement (equal lengths) or one insertion leads from each short word to its long one."""
    if same:
        return (short != long).sum(axis=1) == 1
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


def _best(word: np.ndarray, near: np.ndarray, near_n: np.ndarray) -> pd.DataFrame:
    """Per word: number of near words and the one of largest n, the smallest of equals."""
    frame = pd.DataFrame({"word": word, "best": near, "best_n": near_n}).sort_values(["word", "best_n", "best"], ascending=[True, False, True])
    out = frame.groupby("word", sort=False, as_index=False).first()
    out["n_near"] = frame.groupby("word", sort=False).size().to_numpy()
    return out[["word", "n_near", "best", "best_n"]]


def _searched(group: pd.DataFrame) -> pd.DataFrame:
    base, out = group[group["side"] == BASE], []
    x, xn = base["word"].to_numpy(object), base["n"].to_numpy()
    for side in (SAME, SHORTER):
        own = group[group["side"] == side]
        w, wn = own["word"].to_numpy(object), own["n"].to_numpy()
        i, j = near_pairs(x.tolist(), w.tolist(), side == SAME)
        out.append(_best(w[i], x[j], xn[j]))
        if side == SHORTER:
            out.append(_best(x[j], w[i], wn[i]))
    return pd.concat(out, ignore_index=True)


def near_words(words: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """word, n_near, best, best_n for every word that has a near word. ``words`` must be a stored table (word, n)."""
    trees = fitted(words, sample, block)
    routed = stage(words.mapInPandas(lambda f: _routed(f, trees), "length int, leaf int, side int, word string, n bigint"), "routed")
    limit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(1 << 24) / F.col("length"))))
    is_base = F.col("side") == BASE
    parts = lambda kept: F.greatest(F.lit(1), F.ceil(F.count_if(kept) / F.first(limit))).cast("int")
    sizes = routed.groupBy("length", "leaf").agg(parts(is_base).alias("bases"), parts(~is_base).alias("queries"))
    spot = lambda c: F.pmod(F.xxhash64("word"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = (
        routed.join(sizes, ["length", "leaf"])
        .withColumn("b", F.explode(F.when(is_base, F.array(spot("bases"))).otherwise(every("bases"))))
        .withColumn("q", F.explode(F.when(is_base, every("queries")).otherwise(F.array(spot("queries")))))
        .select("length", "leaf", "b", "q", "side", "word", "n")
    )
    found = dealt.groupBy("length", "leaf", "b", "q").applyInPandas(_searched, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.m")).alias("best_n")
    )


def grouped(words: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n)."""
    words = stage(words, "words")
    near = near_words(words, sample, block)
    doubled = F.col("best_n") >= 2 * F.col("n")
    forms = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(doubled, F.col("best")).alias("form"), F.when(doubled, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    links = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1.0, math.log2(most))))):  # n doubles along a chain
        links = stage(links, "links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


_CRC = (
    "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(octet_length(encode(k))), "
    "lambda i: ('0x' || hex(encode(k))[2 * i + 1:2 * i + 2])::UBIGINT)), lambda c, b: "
    "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda d, z: "
    "xor(d >> 1, 3988292384::UBIGINT * (d & 1)))), 4294967295::UBIGINT)"
)

SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
), lowered AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || word AS k, word, count(*) AS n
  FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM runs) GROUP BY ALL
), hashed AS (SELECT *, {_CRC} AS h FROM lowered
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(word, (h % length(word))::INT) || substr(word, (h % length(word))::INT + 2) ELSE word END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
), gaps AS (SELECT DISTINCT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM spots
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, w.word, w.n FROM gaps a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word, a.n FROM gaps a JOIN words w ON a.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, other := other)) AS top FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top.m >= 2 * n THEN top.other END AS form,
         CASE WHEN -top.m >= 2 * n THEN -top.m END::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.next
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""
