"""Pruned search against scoring every pair: the same rows, fewer postings."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.operators import postings as P
from inkwell.operators import retrieval as R
from inkwell.workload import retrieval_queries as WQ


def every_score(lists, factor, tie, k):
    mass = np.zeros(len(factor))
    for weight, numbers in lists:
        mass[numbers] += weight
    scored = [(-round(m * f, 9), t, n) for n, (m, f, t) in enumerate(zip(mass, factor, tie)) if round(m * f, 9) > 0]
    return [n for _, _, n in sorted(scored)[:k]]


def random_part(seed, chunks, tokens, positive=True):
    rng = np.random.default_rng(seed)
    # Few different factors and weights, so that many scores tie.
    factor = np.sort(rng.choice([0.5, 0.8, 1.0, 1.3], chunks))[::-1].copy()
    low = 1 if positive else -2
    lists = [
        (float(rng.integers(low, 6)), np.flatnonzero(rng.random(chunks) < rng.choice([0.02, 0.3, 0.9])).astype(np.int32))
        for _ in range(tokens)
    ]
    return lists, factor, rng.permutation(chunks).astype(np.int32)


@settings(max_examples=300, deadline=None)
@given(seed=st.integers(0, 10**6), chunks=st.integers(1, 200), tokens=st.integers(0, 9), k=st.integers(1, 20), positive=st.booleans())
def test_pruning_keeps_ranks_and_ties(seed, chunks, tokens, k, positive):
    lists, factor, tie = random_part(seed, chunks, tokens, positive)
    mass = np.zeros(chunks)
    best, scores, _ = P.best_numbers(lists, factor, tie, k, mass)
    assert best.tolist() == every_score(lists, factor, tie, k)
    assert not mass.any()


def test_common_tokens_are_read_in_part_only():
    rng = np.random.default_rng(5)
    n = 50_000
    factor = np.sort(rng.uniform(0.3, 2.2, n))[::-1].copy()
    rare = np.sort(rng.choice(n, 60, replace=False)).astype(np.int32)
    common = np.flatnonzero(rng.random(n) < 0.4).astype(np.int32)
    lists = [(0.4, common), (0.3, common[::2]), (6.5, rare)]
    best, _, read = P.best_numbers(lists, factor, np.arange(n), 20)
    assert best.tolist() == every_score(lists, factor, np.arange(n), 20)
    assert read < 1000 < sum(len(x) for _, x in lists)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("many_parts, limits", [(False, Settings()), (True, Settings()), (True, Settings(broadcast_max_rows=10))])
def test_lists_equal_those_of_all_pairs(spark, sf, monkeypatch, many_parts, limits):
    if many_parts:
        monkeypatch.setattr(P, "PART_CHUNKS", 7)
        monkeypatch.setattr(P, "BLOCK_TERMS", 40)
        monkeypatch.setattr(P, "SALT_PARTS", 2)
    docs, asked = WQ.document_chunks(spark, sf), WQ.benchmark_queries(spark, sf)
    index = R.temporary_index(docs)
    assert (index.members.count() > 5) == many_parts
    pairs = R.pair_scores(asked, None, index=index)
    assert same(R.ranked_lists(R.best_pairs(asked, None, 20, settings=limits, index=index), 20), R.ranked_lists(pairs, 20))


def test_scopes_empty_texts_and_null_texts(spark):
    chunks = spark.createDataFrame(
        [("c1", 1, "alpha beta", "a"), ("c2", 2, "alpha", "a"), ("c3", 3, "", "b"), ("c4", 4, None, "b"), ("c5", 5, "!!", "b"),
         ("c6", 6, "alpha beta", "b"), ("c7", 7, "alpha beta", "b")],
        "chunk_id string, pos long, content string, asset_id string",
    )
    scopes = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "b")], "scope_id string, asset_id string")
    asked = spark.createDataFrame(
        [("s", 1, "alpha beta"), ("t", 2, "beta alpha"), ("t", 3, ""), ("t", 4, "!!"), ("t", 5, None), ("t", 6, "absent")],
        "scope_id string, query_id int, query string",
    )
    for k in (1, 2, 10):
        pairs = R.ranked_lists(R.pair_scores(asked, chunks, scopes), k)
        assert same(R.ranked_lists(R.best_pairs(asked, chunks, k, scopes), k), pairs)


def test_no_chunks_and_no_queries(spark):
    none = spark.createDataFrame([], "chunk_id string, pos long, content string")
    some = spark.createDataFrame([("c", 1, "alpha")], "chunk_id string, pos long, content string")
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    assert R.best_pairs(asked, none, 3).isEmpty()
    assert R.best_pairs(asked.limit(0), some, 3).isEmpty()
    assert R.hybrid_search(asked, some, 3).count() == 1


def test_parts_grow_in_number_not_in_size():
    assert P.part_count(0, 0, 8) == 1
    assert P.part_count(1000, 50_000, 200) == 1
    assert P.part_count(30_000, 2_000_000, 8) == 8
    assert P.part_count(10**9, 10**11, 200) == 25_000


def test_a_search_shuffles_no_pairs(spark, sf, tmp_path):
    asked = WQ.benchmark_queries(spark, sf)
    index = R.write_index(WQ.document_chunks(spark, sf), str(tmp_path / "index"))
    plan = R.best_pairs(asked, None, 20, index=index)._jdf.queryExecution().optimizedPlan().toString()
    # The token sets of the chunks are not read, only posting lists.
    assert "numbers#" in plan and not re.search(r"[\[ ,]tokens#", plan)
    assert "RepartitionByExpression" in plan
    assert index.postings.select(F.max(F.size("numbers"))).first()[0] <= P.PART_CHUNKS
