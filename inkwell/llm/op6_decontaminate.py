"""Benchmark decontamination by template canonicalisation; DataFrame operations only.

A text becomes a list of tokens in which numbers, units after numbers and names (capitalised words inside a sentence)
turn into typed placeholders. A (document, item, offset) is a diagonal; the whole item is compared token by token on
every diagonal that could meet a rule. Candidates come from one join on hashes of every document offset:

* template windows of the item's own width (``_width``): four tokens, or three where 80 % of the item can agree without
  a run of four; shorter items are one window;
* pairs of literal tokens within groups of three neighbours (four in an item of four). If half of the item agrees, two
  tokens of some groups do. A group of which c tokens agree has at least c - 1 pairs, so m agreeing tokens in n groups have
  at least m - n pairs, and a diagonal with fewer cannot. Pairs are far rarer than words, so few diagonals remain.

So both shares are found wherever the item stands, and no item changes another's result. The rules:

* ``exact``: literal tokens agree on at least half of the item, or on 13 of them with one window among them or beside.
* ``reparameterised``: the template agrees on at least 80 % of the item, at least five literal tokens and half of its
  literal tokens among them, and the slots are consistent: an item's slot value always stands for the same document
  value of the same type.

Defined results: null and empty texts and items match nothing; items of fewer than four tokens match as a whole; repeated documents and
items are reported each; an empty table gives an empty result; further columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import bounded, numbered, stage, table

NAME, UNIT = "\u0001", "\u0002"
UNITS = (
    "km|cm|mm|m|mi|miles?|kilometers?|kilometres?|meters?|metres?|feet|foot|ft|inch(?:es)?|kg|g|mg|grams?|kilograms?|lbs?|pounds?|"
    "ounces?|oz|tons?|liters?|litres?|l|ml|gallons?|hours?|hrs?|h|minutes?|mins?|min|seconds?|secs?|s|days?|weeks?|months?|years?|"
    "mph|kmh|dollars?|cents?|euros?|usd|eur|percent|degrees?"
)


def tokens(text: Column) -> Column:
    """Tokens of the text; names and units carry a mark as their first character."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{UNIT}]", " ")
    numbers = F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "_")
    numbers = F.regexp_replace(numbers, rf"(?<=[0-9])\s?(?=(?:{UNITS})(?![\p{{L}}\p{{N}}]))", f" {UNIT}")
    numbers = F.regexp_replace(numbers, r"(?<=[0-9])(?=\p{L})", " ")
    marked = F.when(text.rlike("[0-9]"), numbers).otherwise(text)
    marked = F.regexp_replace(marked, r"\p{Lu}(?<=[^.!?:\s]\s{1,3}.)(?=\p{Ll})", f"{NAME}$0")
    return F.split(marked, rf"[^\p{{L}}\p{{N}}_{NAME}{UNIT}]+")


def template(token: Column) -> Column:
    digit = (token >= F.lit("0")) & (token < F.lit(":"))
    return (
        F.when(token.startswith(NAME), NAME).when(token.startswith(UNIT), UNIT).when(digit, "0").otherwise(F.lower(token))
    )


def _is_slot(template_token: Column) -> Column:
    return template_token.isin(NAME, UNIT, "0")


def _width(length: Column) -> Column:
    """Tokens of a run that an item of this length has on every diagonal where 80 % of the template agree."""
    return F.when(length.isin(6, 7, 10, 11, 15), 3).otherwise(F.least(length, F.lit(4)))


def _gaps(length: Column) -> Column:
    """Largest distance of two tokens of one group: groups have three tokens, or four in an item of four."""
    return F.when(length == 4, 3).otherwise(2)


def _keys(df: DataFrame, widths: list[int], gaps: list[int]) -> DataFrame:
    """(id, size, kind, at, h) of (id, raw): hashes of template windows of each width and of literal pairs at each distance.

    ``kind`` numbers the widths, then the distances; ``at`` is the first token. Every token is hashed once, windows and pairs combine hashes.
    """
    # each list is used more than once by the step above it, so Spark does not compute it again for every token
    words = df.select("id", "raw", F.transform("raw", lambda t: F.xxhash64(F.lower(t))).alias("word"))
    # marks and digits stand before the colon, letters behind it; all other tokens are their own template
    form = F.zip_with("raw", "word", lambda t, h: F.when(t < F.lit(":"), F.xxhash64(template(t))).otherwise(h))
    hashes = words.select("id", "word", F.size("raw").alias("size"), form.alias("form"))
    size = F.col("size")
    places = F.sequence(F.lit(0), size - 1)
    # beyond the end there are nulls, which hashes skip: such a key is no key of an item, as the index has whole ones only
    window = lambda w: F.transform(places, lambda i: F.xxhash64(*[F.get("form", i + k) for k in range(w)]))
    pair = lambda g: F.transform(places, lambda i: F.xxhash64(F.lit(g), F.get("word", i), F.get("word", i + g)))
    keys = F.when(size > 0, F.concat(*[window(w) for w in widths], *[pair(g) for g in gaps]))
    # the lists must not stand beside the exploded rows, so their size is a column of its own below them
    found = hashes.select("id", "size", keys.alias("keys")).select("id", "size", F.posexplode_outer("keys").alias("pos", "h"))
    return found.where("h IS NOT NULL").select("id", "size", F.expr("pos div size").alias("kind"), (F.col("pos") % F.col("size")).alias("at"), "h")


def items_of(benchmark: DataFrame) -> DataFrame:
    """id, item_id, raw tokens, template form, length."""
    raw = F.filter(tokens(F.col("text")), lambda t: t != "")
    items = numbered(benchmark.select("item_id", raw.alias("raw")), "id").withColumn("form", F.transform("raw", template))
    return stage(items.withColumn("length", F.size("form")), "items")


def _index(items: DataFrame, widths: list[int], gaps: list[int]) -> DataFrame:
    """Keys of the items: (h, item, start, weight, need). A window's weight is enough, a pair is one of ``need``."""
    keys = _keys(items.where("length > 0").select("id", "raw"), widths, gaps)
    of_kind = lambda values, first: F.element_at(F.array(*map(F.lit, values)), F.col("kind").cast("int") - first + 1)
    length, group = F.col("size"), _gaps(F.col("size")) + 1
    width, gap = of_kind(widths, 0), of_kind(gaps, len(widths))
    need = F.greatest(F.lit(1), F.ceil(length / 2) - F.ceil(length / group)).cast("int")
    whole = (width == _width(length)) & (F.col("at") + width <= length)
    window = keys.where(F.col("kind") < len(widths)).where(whole).select("h", "id", "at", need.alias("weight"), need.alias("need"))
    inside = F.floor(F.col("at") / group) == F.floor((F.col("at") + gap) / group)
    whole = (length >= 4) & (F.col("at") + gap < length)
    pair = keys.where(F.col("kind") >= len(widths)).where(whole & inside).select("h", "id", "at", F.lit(1).alias("weight"), need.alias("need"))
    return stage(window.unionByName(pair).select("h", F.col("id").alias("item"), F.col("at").alias("start"), "weight", "need"), "index")


def _candidates(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """Diagonals (uid, item, shift) with a common window or enough literal pairs."""
    lengths = items.where("length > 0").select(_width(F.col("length")).alias("w"), _gaps(F.col("length")).alias("g")).distinct().collect()
    widths, gaps = sorted({r["w"] for r in lengths}), list(range(1, max((r["g"] for r in lengths), default=2) + 1))
    index = _index(items, widths, gaps)
    seen = _keys(docs.select(F.col("uid").alias("id"), tokens(F.col("text")).alias("raw")), widths, gaps)
    met = seen.select("id", "at", "h").join(bounded(index, broadcast_rows), "h")
    shift = (F.col("at") - F.col("start")).alias("shift")
    found = met.groupBy(F.col("id").alias("uid"), "item", shift, "need").agg(F.sum("weight").alias("n"))
    return found.where("n >= need").select("uid", "item", "shift").distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """Returns the numbered documents (uid, row) and the leaks: uid, doc_id, item_id, kind, matched, length, coverage, slots."""
    rows = stage(numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "uid"), "rows")
    texts = rows.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    items = items_of(benchmark)
    found = stage(_candidates(texts, items, broadcast_rows), "candidates")

    wanted = stage(found.select("uid").distinct(), "wanted")
    near = texts.join(bounded(wanted, broadcast_rows), "uid").select("uid", "doc_id", tokens(F.col("text")).alias("doc"))
    both = found.join(stage(near, "near"), "uid").join(items.select(F.col("id").alias("item"), "item_id", "raw", "form", "length"), "item")
    place = F.sequence(F.lit(0), F.col("length") - 1)
    pairs = F.transform(
        place,
        lambda j: F.struct(
            F.get("form", j).alias("want"), F.get("raw", j).alias("value"), F.get("doc", F.col("shift") + j).alias("have"),
        ),
    )
    agree = F.filter("pairs", lambda p: p["want"] == template(p["have"]))
    slots = F.filter("agree", lambda p: _is_slot(p["want"]))
    literal = F.filter("agree", lambda p: F.lower(p["value"]) == F.lower(p["have"]))
    plain = F.filter("pairs", lambda p: ~_is_slot(p["want"]))
    plain_agree = F.filter("agree", lambda p: ~_is_slot(p["want"]))
    mapping = F.array_distinct(F.transform("slots", lambda p: F.struct(p["value"].alias("value"), p["have"].alias("have"))))
    values = F.array_distinct(F.transform("slots", lambda p: p["value"]))
    compared = (
        both.select("uid", "doc_id", "item", "item_id", "length", pairs.alias("pairs"))
        .withColumn("agree", agree)
        .withColumn("slots", slots)
        .select(
            "uid", "doc_id", "item", "item_id", "length",
            F.size("agree").alias("matched"), F.size(literal).alias("literal"), F.size(plain).alias("plain"),
            F.size(plain_agree).alias("plain_matched"), F.size("slots").alias("slots"),
            (F.size(mapping) == F.size(values)).alias("consistent"),
        )
    )
    exact = (2 * F.col("literal") >= F.col("length")) | (F.col("literal") >= 13)
    again = (
        (10 * F.col("matched") >= 8 * F.col("length"))
        & (F.col("plain_matched") >= 5)
        & (2 * F.col("plain_matched") >= F.col("plain"))
        & F.col("consistent")
    )
    kind = F.when(exact, "exact").when(again, "reparameterised")
    best = (
        compared.withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .groupBy("uid", "item")
        .agg(F.max(F.struct("matched", "literal", "kind", "slots", "length", "doc_id", "item_id")).alias("m"))
    )
    result = best.select(
        "uid", "m.doc_id", "m.item_id", "m.kind", "m.matched", "m.length", (F.col("m.matched") / F.col("m.length")).alias("coverage"), "m.slots"
    )
    return rows, result


def decontaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents without any leak, with their own columns."""
    rows, found = leaks(docs, benchmark, broadcast_rows=broadcast_rows)
    return rows.join(bounded(stage(found.select("uid").distinct(), "leaky"), broadcast_rows), "uid", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.drop("uid")
