"""Posting lists ordered by impact, and exact top-k search that leaves out what cannot rank.

Layout
------
The chunks of an index are dealt by hash into parts of bounded size. Inside a part chunks are numbered from the largest
length factor to the smallest, and a token's posting list holds these numbers in ascending order. A chunk's BM25 score
is its factor times the idf of the matched tokens, so a prefix of every list holds the chunks with the largest impact.

``members``   one row per part: the chunks' ids, positions, factors and tie order as arrays, by number.
``postings``  one row per part, scope and token: the numbers of the chunks that hold it.

Search
------
A query reads its lists from the rarest token to the most common one. Partial scores give a lower bound of the k-th
best score. A chunk not met so far scores at most its factor times the idf still to come, so only the prefix of a
list where this reaches the bound is read; chunks met before are looked up in the rest by binary search, as long as
they themselves can still reach it. Bounds keep ties, so the rows equal those of scoring every pair.

Only posting lists of query tokens leave the scan. A group is one part with one block of queries; both are bounded,
and parts grow in number, not in size, with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

#: A part holds at most about this many postings and chunks; below it, parts follow the shuffle partitions.
PART_POSTINGS = 4_000_000
PART_CHUNKS = 65_536
#: Parts smaller than this are not worth a task of their own.
SMALL_PART = 65_536
#: Query terms of one block.
BLOCK_TERMS = 65_536
#: Parts that one salt of a shuffled token join covers.
SALT_PARTS = 64
#: Scores are rounded to nine digits, so bounds may be missed by this much without changing a rank.
SLACK = 1e-8

MEMBER_ARRAYS = ("chunk_id", "pos", "factor", "has_tokens", "tie")


def part_count(chunks: int, postings: int, partitions: int) -> int:
    """As many parts as bounded parts need, and one per shuffle partition if these are not tiny."""
    needed = max(-(-postings // PART_POSTINGS), -(-chunks // PART_CHUNKS), 1)
    return max(needed, min(partitions, -(-postings // SMALL_PART)))


def numbered_chunks(corpus: DataFrame, factors: Column, totals: DataFrame, partitions: int) -> DataFrame:
    """``part, number, tie, scope_id, chunk_id, pos, factor, has_tokens, tokens`` of every chunk with a text.

    A chunk whose text is null has no token and is never found. ``number`` orders a part's chunks by impact, ``tie`` by position; both start at 0.
    """
    size = totals.agg(F.sum("n_chunks"), F.sum(F.col("n_chunks") * F.col("avg_len"))).first()
    parts = part_count(int(size[0] or 0), int(size[1] or 0), partitions)
    placed = corpus.where(F.col("tokens").isNotNull()).join(totals.select("scope_id", "avg_len"), "scope_id").select(
        F.pmod(F.xxhash64("scope_id", "chunk_id"), F.lit(parts)).cast("int").alias("part"),
        "scope_id", "chunk_id", "pos", factors.alias("factor"), "has_tokens", "tokens",
    )
    within = Window.partitionBy("part")
    return placed.select(
        "*",
        (F.row_number().over(within.orderBy(F.col("factor").desc(), "pos", "chunk_id", "scope_id")) - 1).alias("number"),
        (F.row_number().over(within.orderBy("pos", "chunk_id", "scope_id")) - 1).alias("tie"),
    )


def member_rows(numbered: DataFrame) -> DataFrame:
    """One row per part with the arrays of ``MEMBER_ARRAYS``."""
    rows = F.sort_array(F.collect_list(F.struct("number", *MEMBER_ARRAYS)))
    listed = numbered.groupBy("part").agg(rows.alias("rows"))
    return listed.select("part", *[F.col("rows")[c].alias(c) for c in MEMBER_ARRAYS])


def posting_rows(numbered: DataFrame) -> DataFrame:
    """``part, scope_id, token, numbers``; a list is bounded by its part."""
    exploded = numbered.select("part", "scope_id", "number", F.explode_outer("tokens").alias("token"))
    return exploded.groupBy("part", "scope_id", "token").agg(F.sort_array(F.collect_list("number")).alias("numbers"))


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


def best_numbers(
    lists: list[tuple[float, np.ndarray]], factor: np.ndarray, tie: np.ndarray, k: int, mass: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best chunks of one part for one query: numbers, scores, and how many postings were read.

    ``lists`` holds (weight, ascending numbers) per query token, ``factor`` is descending. Scores are factor times the
    matched weights; those not above zero do not count, ties go to the smaller ``tie``. ``mass`` is a zeroed array of a
    part's length that is left zeroed. Non-positive weights (a corpus of few tokens) leave nothing out.
    """
    lists = sorted(lists, key=lambda one: (len(one[1]), -one[0]))
    weights = np.array([w for w, _ in lists])
    rest = np.append(np.cumsum(weights[::-1])[::-1], 0.0)
    pruned = bool(len(weights)) and weights.min() > 0
    mass = np.zeros(len(factor)) if mass is None else mass
    met = np.empty(0, np.int64)
    bound, read = 0.0, 0
    for i, (weight, numbers) in enumerate(lists):
        open_end = len(numbers)
        if pruned and bound > 0:
            reachable = int(np.searchsorted(-factor, -(bound - SLACK) / rest[i], side="right"))
            open_end = int(np.searchsorted(numbers, reachable))
            late = met[met >= reachable]
            late = late[factor[late] * (mass[late] + rest[i]) >= bound - SLACK]
            closed = numbers[open_end:]
            if len(late) and len(closed):
                at = np.minimum(np.searchsorted(closed, late), len(closed) - 1)
                found = late[closed[at] == late]
                mass[found] += weight
                read += len(found)
        opened = numbers[:open_end]
        # Weights that are not positive can cancel out, so a mass of 0 proves a first meeting only without them.
        met = np.concatenate([met, opened[mass[opened] == 0]]) if pruned else np.union1d(met, opened)
        mass[opened] += weight
        read += open_end
        if pruned and i + 1 < len(lists):
            bound = _kth(mass[met] * factor[met], k)
    scores = mass[met] * factor[met]
    mass[met] = 0.0
    keys = np.rint(scores * 1e9)
    hits = np.flatnonzero(keys > 0)
    if len(hits) > k:
        hits = hits[keys[hits] >= _kth(keys[hits], k)]
    hits = hits[np.lexsort((tie[met[hits]], -keys[hits]))[:k]]
    return met[hits], scores[hits], read


def _asked_by(postings: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct queries, and per query token (sorted by query): query code, posting row, whether the query has tokens."""
    asked = postings.column("asked").combine_chunks()
    owner = pc.list_parent_indices(asked).to_numpy()
    flat = asked.flatten()
    coded = flat.field("query_id").dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    return coded.dictionary, codes[order], owner[order], flat.field("query_has_tokens").to_numpy(zero_copy_only=False)[order]


def _searcher(k: int, overlap: bool, bm25: bool, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def search(group: pa.Table) -> pa.Table:
        is_member = pc.is_valid(group.column("factor"))
        postings = group.filter(pc.invert(is_member))
        members = group.filter(is_member)
        if not postings.num_rows or not members.num_rows:
            return schema.empty_table()
        member = {c: members.column(c).combine_chunks().flatten() for c in MEMBER_ARRAYS}
        factor, tie = member["factor"].to_numpy(), member["tie"].to_numpy()
        has_tokens = member["has_tokens"].to_numpy(zero_copy_only=False)
        numbers = postings.column("numbers").combine_chunks()
        ends, flat = numbers.offsets.to_numpy(), numbers.values.to_numpy()
        idf = postings.column("idf").to_numpy()
        ones, mass = np.ones(len(factor)), np.zeros(len(factor))
        queries, codes, owner, worded = _asked_by(postings)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        out_query, out_number, out_overlap, out_bm25 = [], [], [], []
        for start, end in zip(starts, np.append(starts[1:], len(codes))):
            rows = owner[start:end]
            lists = [(idf[r], flat[ends[r] : ends[r + 1]]) for r in rows]
            found: dict[int, list] = {}
            if bm25:
                best, scores, _ = best_numbers(lists, factor, tie, k, mass)
                found.update((n, [None, s]) for n, s in zip(best.tolist(), scores.tolist()))
            if overlap and worded[start]:
                counted = [(1.0, n if has_tokens.all() else n[has_tokens[n]]) for _, n in lists]
                best, scores, _ = best_numbers(counted, ones, tie, k, mass)
                for n, s in zip(best.tolist(), scores.tolist()):
                    found.setdefault(n, [None, None])[0] = s
            out_query.extend([codes[start]] * len(found))
            out_number.extend(found)
            out_overlap.extend(o for o, _ in found.values())
            out_bm25.extend(b for _, b in found.values())
        at = pa.array(out_number, pa.int64())
        columns = [
            queries.take(pa.array(out_query, pa.int64())), member["chunk_id"].take(at), member["pos"].take(at),
            pa.array(out_overlap, pa.float64()), pa.array(out_bm25, pa.float64()),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return search


def part_winners(
    members: DataFrame, postings: DataFrame, terms: DataFrame, k: int, partitions: int, broadcast_terms: int,
    overlap: bool = True, bm25: bool = True,
) -> DataFrame:
    """``query_id, chunk_id, pos, overlap, bm25``: the best ``k`` of every part and query by either score.

    ``terms(scope_id, token, idf, query_id, query_has_tokens)`` are the queries' tokens. A score is null where the chunk
    is not among its part's best by it. Up to ``broadcast_terms`` terms are broadcast to the posting lists; more are
    joined by a shuffle with one salt per ``SALT_PARTS`` parts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n_terms = terms.count()
    blocks = max(1, -(-n_terms // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    needed = terms.groupBy("scope_id", "token", block.alias("block")).agg(
        F.first("idf").alias("idf"), F.collect_list(F.struct("query_id", "query_has_tokens")).alias("asked")
    )
    keys = ["scope_id", "token"]
    if n_terms <= broadcast_terms:
        wanted = postings.join(F.broadcast(needed), keys)
    else:
        salts = members.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] // SALT_PARTS + 1
        salted = needed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        wanted = postings.withColumn("salt", (F.col("part") / SALT_PARTS).cast("int")).join(salted, [*keys, "salt"])
    lists = wanted.select("part", "block", "idf", "asked", "numbers")
    every = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # An explicit count keeps small groups on different tasks.
    groups = lists.unionByName(every, allowMissingColumns=True).repartition(partitions, "part", "block")
    result = S.StructType([
        S.StructField("query_id", terms.schema["query_id"].dataType),
        S.StructField("chunk_id", members.schema["chunk_id"].dataType.elementType),
        S.StructField("pos", members.schema["pos"].dataType.elementType),
        S.StructField("overlap", S.DoubleType()),
        S.StructField("bm25", S.DoubleType()),
    ])
    return groups.groupBy("part", "block").applyInArrow(_searcher(k, overlap, bm25, to_arrow_schema(result)), result)
