"""Held-out contamination: which texts of a corpus hold shingles of a held-out set, and how much of the set is exposed.

The held-out shingles are hashed into a Bloom filter by two aggregates (bits of a word are OR-ed before the shuffle). Its
words are one array of bounded size, which Spark computes once as a scalar subquery. The corpus scan keeps of every text only the
shingles that the filter may hold, and drops texts without any, before shingles become rows. What passes is then
compared exactly, as text, so the filter decides nothing but cost: false positives fail the join, and there are no
false negatives. Only distinct shingles are joined, never texts with held-out items.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import materialized

WIDTH = 5
PROBES = 4
BITS_PER_SHINGLE = 12
MOST_BITS = 1 << 26


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Distinct shingles of ``width`` lower-case words (letters and digits); a shorter text is one shingle, an empty one has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
    joined = lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, width), " "))
    # the one-element array binds the words, so that they are found once and not once per shingle
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_distinct(joined(w))).otherwise(F.array().cast("array<string>")))
    return F.element_at(bound, 1)


def _place(shingle: Column, probe: int, bits: int) -> Column:
    """Bit number of one probe."""
    return F.pmod(F.xxhash64(shingle, F.lit(probe)), F.lit(bits))


def _mask(place: Column) -> Column:
    """The bit of a place within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))


def bloom_words(held: DataFrame, bits: int) -> DataFrame:
    """One row with the filter's words (array of 64-bit integers) of the column ``shingle``."""
    places = F.array(*[_place(F.col("shingle"), p, bits) for p in range(PROBES)])
    set_bits = held.select(F.explode_outer(places).alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    words = set_bits.agg(F.bit_or(_mask(F.col("place"))).alias("mask"))
    every = held.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))))
    return every.agg(F.transform(ordered, lambda s: s["mask"]).alias("words"))


def may_hold(words: Column, shingle: Column, bits: int) -> Column:
    """False only if the filter cannot hold the shingle."""
    held = F.lit(True)
    for p in range(PROBES):
        place = _place(shingle, p, bits)
        held = held & (F.get(words, F.shiftright(place, 6).cast("int")).bitwiseAND(_mask(place)) != 0)
    return held


def filter_bits(count: int) -> int:
    """Power of two with some twelve bits a shingle, at most 8 MB in all; a fuller filter passes more, loses nothing."""
    return max(1 << 10, min(MOST_BITS, 1 << math.ceil(math.log2(max(1, count) * BITS_PER_SHINGLE))))


def candidate_shingles(corpus: DataFrame, held: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id, n_shingles, candidates`` of the texts (id, text) of which the filter may hold some shingle."""
    bits = filter_bits(held.count())
    found = corpus.select("id", shingles(F.col("text"), width).alias("shingles"), bloom_words(held, bits).scalar().alias("words"))
    passed = F.filter("shingles", lambda s: may_hold(F.col("words"), s, bits))
    return found.select("id", F.size("shingles").alias("n_shingles"), passed.alias("candidates")).where(F.size("candidates") > 0)


def held_out_shingles(held: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stored ``item, shingle`` rows of the held-out texts (id, text)."""
    rows = held.select(F.col("id").alias("item"), F.explode_outer(shingles(F.col("text"), width)).alias("shingle"))
    return materialized(rows.where("shingle IS NOT NULL"), "held-out-shingles")


def contamination(corpus: DataFrame, held: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Contaminated texts and exposed items.

    First table: ``id, n_shingles, n_hits, hit_share`` of every corpus row (id, text) that holds a held-out shingle; repeated ids
    are rows of their own kind and counted by row. Second: ``item, n_shingles, n_found, found_share`` of every held-out item.
    """
    items = held_out_shingles(held, width)
    distinct = materialized(items.select("shingle").distinct(), "held-out-distinct")
    numbered = candidate_shingles(corpus, distinct, width).withColumn("row", F.monotonically_increasing_id())
    candidates = materialized(numbered, "contamination-candidates")
    hits = materialized(
        candidates.select("row", F.explode_outer("candidates").alias("shingle")).join(distinct, "shingle", "left_semi"), "contamination-hits"
    )
    counted = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_hits"))
    texts = candidates.join(counted, "row").select(
        "id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "n_hits", (F.col("n_hits") / F.col("n_shingles")).alias("hit_share")
    )
    seen = hits.select("shingle").distinct().withColumn("found", F.lit(1))
    exposed = items.join(seen, "shingle", "left").groupBy("item").agg(
        F.count(F.lit(1)).alias("n_shingles"), F.count("found").alias("n_found"), (F.count("found") / F.count(F.lit(1))).alias("found_share")
    )
    return texts, exposed
