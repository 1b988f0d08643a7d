"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame operations only.

Every source's documents are laid end to end in hash order and cut into blocks of ``block_words`` words. Slot i of the
schedule belongs to the source in whose interval of the cumulative slot weights the fractional part of i times the
golden ratio falls. The r-th slot of a source takes block r of its line, from the start again after the last block, until the
source's target is used up. A document is taken as often as slots cover its words.

Sources rank by code point, null last, and weigh ``weights`` in turn. Together they share ``share`` of all words; a
target stops at ``repeats`` times its source's size, and the excess is shared again by weight until no target is above.

Running sums and ranks work in segments with carried totals, so a source with a third of all rows is spread over many
tasks. The order depends on doc_id, text and size alone, so reruns agree.

Defined results: a null or empty text has size 0 and is never taken; null is a source; repeated rows take their own
places; sources without words have target 0; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import bounded, numbered, stage, table

WEIGHTS = (5, 2, 1)
GOLDEN = (math.sqrt(5) - 1) / 2
#: Any interval of 1/n of the circle holds one of the first GAP * n points of the golden sequence (three-gap theorem).
GAP = 2.7
CHUNK = 1 << 20
ROWS_PER_SEGMENT = 20_000
BINS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """uid, doc_id, source, size and the place ``h`` in the shuffled line."""
    place = F.xxhash64(F.lit(seed), "doc_id", "text")
    return stage(numbered(docs.select("doc_id", "source", words(F.col("text")).alias("size"), place.alias("h")), "uid"), "sizes")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """One row per source: sid (rank), source, source_size, target."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = stage(
        sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = ordered.join(F.broadcast(before), "part").select(
        (F.col("before") + inside - 1).alias("sid"), "source", "source_size", (F.col("source_size") * repeats).alias("most")
    )
    ranked = stage(ranked.withColumn("weight", weight), "weights")

    free = F.col("weight") * F.lit(0.0) < F.col("most")
    total = ranked.agg((F.sum("source_size") * share).alias("t")).first()["t"] or 0.0
    level, open_before = 0.0, None
    while True:
        row = ranked.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("most"))).alias("m"), F.count_if(free).alias("n")
        ).first()
        if not row["w"]:
            level = math.inf
            break
        level = max(0.0, total - (row["m"] or 0.0)) / row["w"]
        if row["n"] == open_before:
            break
        open_before = row["n"]
        free = F.col("weight") * F.lit(level) < F.col("most")
    target = F.col("most") if math.isinf(level) else F.least("most", F.col("weight") * F.lit(level))
    return ranked.select("sid", "source", "source_size", target.alias("target"))


def _before(df: DataFrame, key: str, segment: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of the key: inside segments, plus the totals of earlier segments."""
    work = df.withColumn("seg", segment)
    upto = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(key, "seg").agg(F.sum(value).alias("total"))
    carried = totals.select(key, "seg", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("carried"))
    inside = Window.partitionBy(key, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        work.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(carried, [key, "seg"])
        .withColumn(name, F.col("carried") + F.col("inside"))
        .drop("seg", "inside", "carried")
    )


def line(rows: DataFrame, plan: DataFrame, broadcast_sources: int = 100_000) -> DataFrame:
    """Rows with words and their place [start, start + size) in their source's shuffled line."""
    count = rows.count()
    bits = max(8, math.ceil(math.log2(max(1, count) / ROWS_PER_SEGMENT)) if count else 8)
    known = bounded(plan.select("sid", F.col("source").alias("its_source")), broadcast_sources)
    keyed = rows.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("its_source"))).select("uid", "doc_id", "sid", "size", "h")
    return _before(keyed, "sid", F.shiftright("h", 64 - bits), ["h", "doc_id", "size", "uid"], F.col("size"), "start")


def schedule(spark: SparkSession, plan: DataFrame, block_words: int = 4096) -> DataFrame:
    """The slots in use: slot, sid, block, epoch, take (words of the block that the slot takes)."""
    blocks = F.ceil(F.col("source_size") / block_words)
    goal = F.round("target").cast("bigint")
    rounds = F.floor(F.col("goal") / F.col("source_size"))
    needed = rounds * F.col("blocks") + F.ceil((F.col("goal") - rounds * F.col("source_size")) / block_words)
    some = plan.where("source_size > 0 AND target >= 0.5").withColumn("goal", goal).withColumn("blocks", blocks)
    some = stage(some.withColumn("needed", needed.cast("bigint")).where("needed > 0"), "needs")
    total = some.agg(F.sum("needed").alias("n")).first()["n"] or 0

    edges = _before(some, "whole", F.floor(F.col("sid") / 4096), ["sid"], F.col("needed"), "low") if total else some.withColumn("low", F.lit(0))
    edges = edges.select(
        "sid", "source_size", "blocks", "goal", "needed",
        (F.col("low") / max(1, total)).alias("low"), ((F.col("low") + F.col("needed")) / max(1, total)).alias("high"),
    )
    bins = F.sequence(F.floor(F.col("low") * BINS), F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1)))
    edges = edges.withColumn("bin", F.explode(bins))

    point = (F.floor(F.col("id") / CHUNK) * F.lit(CHUNK * GOLDEN % 1.0) + (F.col("id") % CHUNK) * F.lit(GOLDEN)) % F.lit(1.0)
    points = spark.range(math.ceil(GAP * total) + 16 * (total > 0)).select(F.col("id").alias("slot"), point.alias("u"))
    points = points.withColumn("bin", F.floor(F.col("u") * BINS))
    owned = points.join(edges, "bin").where("u >= low AND u < high").drop("bin", "u", "low", "high")
    ranked = _before(owned, "sid", F.floor(F.col("slot") / 8192), ["slot"], F.lit(1), "rank").where("rank < needed")
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    block = F.col("rank") - epoch * F.col("blocks")
    used = epoch * F.col("source_size") + block * block_words
    length = F.least(F.lit(block_words).cast("bigint"), F.col("source_size") - block * block_words)
    return ranked.select("slot", "sid", block.alias("block"), epoch.alias("epoch"), F.least(length, F.col("goal") - used).alias("take"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    repeats: float = 2.0,
    block_words: int = 4096,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns sizes, targets and pieces: slot, epoch, uid, doc_id, from_word, to_word in the order of the slots."""
    rows = sizes(docs, seed)
    plan = stage(targets(rows, weights, share, repeats).withColumn("whole", F.lit(0)), "targets")
    slots = schedule(docs.sparkSession, plan, block_words)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    placed = line(rows, plan).withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("take"))
    pieces = placed.join(slots, ["sid", "block"]).select(
        "slot", "epoch", "uid", "doc_id", (begin - F.col("start")).alias("from_word"), (end - F.col("start")).alias("to_word")
    )
    return rows, plan, pieces.where("to_word > from_word")


def taken(docs: DataFrame, broadcast_sources: int = 100_000, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    rows, plan, pieces = mix(docs, **options)
    sums = pieces.groupBy("uid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    known = bounded(plan.select(F.col("source").alias("its_source"), "source_size", "target"), broadcast_sources)
    return (
        rows.select("uid", "doc_id", "source", "size")
        .join(known, F.col("source").eqNullSafe(F.col("its_source")))
        .join(sums, "uid", "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).drop("source")
