"""Identity, similarity, contamination and trajectories against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkwell.operators import contamination, identity, similarity, trajectories


def least_reachable(nodes, groups):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for group in groups:
        for a, b in itertools.pairwise(sorted(group)):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_repeated_keys(spark):
    rng = random.Random(1)
    rows = [(i, f"chain{i // 2}") for i in range(200)] + [(i + 1, f"chain{i // 2}x") for i in range(0, 199)]
    rows += [(1000 + i, "hub") for i in range(300)] + [(rng.randrange(2000, 2400), f"k{rng.randrange(300)}") for _ in range(500)]
    rows += [(5000, None), (None, "hub"), (5001, "alone")] + rows[:20]
    got = {r["id"]: r["component"] for r in identity.components(spark.createDataFrame(rows, "id bigint, key string").where("id IS NOT NULL")).collect()}
    groups = {}
    for i, k in rows:
        if i is not None and k is not None:
            groups.setdefault(k, set()).add(i)
    want = least_reachable({i for i, _ in rows if i is not None}, groups.values())
    shared = {i for g in groups.values() if len(g) > 1 for i in g}
    assert got == {i: want[i] for i in shared}


def test_identity_classes_of_null_and_equal_keys(spark):
    rows = [(1, "A b!", None), (2, "a  B", "x"), (3, None, "X."), (4, "!!", None), (5, None, None), (6, "c", "c"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc bigint, one string, two string")
    keys = [identity.digest_key("one", identity.normalised(F.col("one"))), identity.digest_key("two", identity.normalised(F.col("two")))]
    got = {r["id"]: (r["component"], r["kept"]) for r in identity.identity_classes(df, "doc", keys).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True), 6: (6, True)}
    assert identity.identity_classes(df.limit(0), "doc", keys).count() == 0


def question_rows():
    rng = np.random.default_rng(4)
    out, number = [], itertools.count()
    for _ in range(30):
        centre = rng.normal(size=8)
        out += [(next(number), (centre + rng.normal(size=8) * s).astype(np.float32).tolist()) for s in rng.choice([0, 0.05, 0.2, 0.6], 6)]
    dense = rng.normal(size=8)
    out += [(next(number), (dense + rng.normal(size=8) * 0.03).astype(np.float32).tolist()) for _ in range(70)]  # one large bucket
    out += [(900, None), (901, []), (902, [0.0] * 8), (903, [0.0] * 8), (904, [float("nan")] * 8), (905, [1.0, 2.0]), (None, out[0][1])]
    return out + [(906, out[0][1]), (906, out[0][1])]


@pytest.mark.parametrize("block", [8, similarity.BLOCK])
def test_near_duplicates_equal_all_pairs(spark, block):
    rows, t = question_rows(), 0.95
    got = similarity.near_duplicates(spark.createDataFrame(rows, "id bigint, vector array<float>"), t, block=block).collect()
    classes = {}
    for i, v in rows:
        if i is not None:
            classes.setdefault(repr(v), []).append(i)
    vectors = {min(ids): eval(v, {"nan": math.nan}) for v, ids in classes.items()}
    usable = {i: np.array(v) for i, v in vectors.items() if v and len(v) == 8 and 0 < np.linalg.norm(v) < math.inf}
    pairs = [
        (a, b) for a, b in itertools.combinations(usable, 2)
        if round(usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b]), 9) >= t
    ]
    assert len(pairs) > 1000
    roots = least_reachable(vectors, pairs)
    want = []
    for v, ids in classes.items():
        own = min(ids)
        want += [(i, own, len(ids), sum(own in p for p in pairs), roots[own]) for i in ids]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id bigint, vector array<float>")
    assert sorted(tuple(r) for r in similarity.near_duplicates(df, 0.9).collect()) == [(1, 1, 2, 0, 1), (2, 1, 2, 0, 1)]
    assert similarity.near_duplicates(df.limit(0), 0.9).count() == 0


def test_band_plan_misses_no_pair_at_the_threshold():
    for t, n in itertools.product((0.5, 0.8, 0.9, 0.99), (10, 10_000, 10**9)):
        bits, bands = similarity.band_plan(t, n)
        assert (1 - (1 - math.acos(t) / math.pi) ** bits) ** bands <= 1e-6


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_contamination_equals_brute_force_with_a_full_filter(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    held = [(i, text(rng.choice([3, 8, 30]))) for i in range(20)] + [(50, None), (51, ""), (52, "…")]
    corpus = [(i, text(rng.choice([1, 4, 20, 400]))) for i in range(60)] + [(100, None), (101, ""), (102, held[0][1].upper() + "!")]
    corpus += [(103, "start " + held[5][1] + " end"), (104, text(30_000)), (103, "start " + held[5][1] + " end")]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, text string")
    known = set().union(*(shingle_set(t) for _, t in held))
    want = sorted((i, len(s), len(s & known), len(s & known) / len(s)) for i, t in corpus if (s := shingle_set(t)) & known)
    seen = set().union(*(shingle_set(t) for _, t in corpus))
    exposed = sorted((i, len(s), len(s & seen), len(s & seen) / len(s)) for i, t in held if (s := shingle_set(t)))
    for most in (contamination.MOST_BITS, 1 << 10):
        monkeypatch.setattr(contamination, "MOST_BITS", most)
        texts, items = contamination.contamination(frame(corpus), frame(held))
        assert sorted(tuple(r) for r in texts.collect()) == want
        assert sorted(tuple(r) for r in items.collect()) == exposed
    texts, items = contamination.contamination(frame(corpus).limit(0), frame(held).limit(0))
    assert (texts.count(), items.count()) == (0, 0)


def test_filter_is_part_of_the_scan_and_keeps_every_held_out_shingle(spark):
    held = spark.createDataFrame([(f"a b c d {i}",) for i in range(500)], "shingle string")
    corpus = spark.createDataFrame([(1, "a b c d 7"), (2, "nothing of it"), (3, "a b c d 600")], "id bigint, text string")
    found = contamination.candidate_shingles(corpus, held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "filter(" in plan
    assert [r["id"] for r in found.collect()] == [1]
    bits = contamination.filter_bits(500)
    inside = held.withColumn("words", contamination.bloom_words(held, bits).scalar())
    assert inside.where(~contamination.may_hold(F.col("words"), F.col("shingle"), bits)).count() == 0
    others = spark.createDataFrame([(f"x {i}",) for i in range(5000)], "shingle string").withColumn("words", contamination.bloom_words(held, bits).scalar())
    assert others.where(contamination.may_hold(F.col("words"), F.col("shingle"), bits)).count() < 100


@pytest.mark.parametrize("size", [3, trajectories.PIECE])
def test_returns_over_pieces_and_partitions(spark, size):
    rng = random.Random(2)
    rows = [(u, t, rng.choice("abc"), rng.random(), rng.random()) for u, n in ((1, 200), (2, 1), (3, 40), (None, 5)) for t in range(n)]
    rows.append((4, 0, None, None, None))
    df = spark.createDataFrame(rows, "trajectory bigint, at int, state string, reward double, potential double").withColumn("action", F.lit("x"))
    got = {(r["trajectory"], r["at"]): r for r in trajectories.transitions(df.repartition(6), ["at"], 0.9, size).collect()}
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for u, own in by.items():
        total, after, potential = 0.0, None, 0.0
        for _, at, state, reward, value in reversed(own):
            total = (reward or 0) + 0.9 * total
            g = got[u, at]
            assert (g["next_state"], g["done"]) == (after, at == len(own) - 1)
            assert math.isclose(g["discounted_return"], total) and math.isclose(g["shaped_reward"], (reward or 0) + 0.9 * potential - (value or 0), abs_tol=1e-12)
            after, potential = state, value or 0
    assert trajectories.transitions(df.limit(0), ["at"], 0.9).count() == 0


def test_a_class_enters_about_as_many_tables_as_rows_grow():
    tables = [similarity.table_plan(0.9, n)[1] for n in (10_000, 100_000, 1_000_000)]
    assert max(tables) <= 1.1 * min(tables) <= 40
    assert similarity.table_plan(0.9, 10**8)[1] <= 2 * tables[0]


def test_meeting_chance_is_a_lower_bound():
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((2, 4000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    directions, tables = similarity.table_plan(0.9, 4000)
    axes = rng.standard_normal((12, directions * 20))
    met = np.mean(similarity._keys((x @ axes).reshape(4000, 20, -1)) == similarity._keys((y @ axes).reshape(4000, 20, -1)))
    assert similarity.meeting_chance(0.9, directions) < met + 0.02 and met > 0.25
    assert (1 - similarity.meeting_chance(0.9, directions)) ** tables <= 1e-6


def test_links_across_tiles(monkeypatch):
    rng = np.random.default_rng(9)
    dense = rng.normal(size=8)
    packed = [(dense + rng.normal(size=8) * 0.01).astype("<f4").tobytes() for _ in range(50)]
    group = pd.DataFrame({"class_id": range(50), "packed": packed, "keys": [np.array([i % 2, 3], "<u2").tobytes() for i in range(50)]})
    group = group.assign(place=1, block=0, first=0, second=0).sample(frac=1, random_state=1)
    monkeypatch.setattr(similarity, "TILE", 7)
    got = similarity._linked(group, 0.9, "<f4")
    # pairs of equal parity met in the first table
    assert set(got["links"]) == {25} and set(got["least"]) == {0} and sorted(got["class_id"]) == list(range(50))
