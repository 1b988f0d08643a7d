"""Bootstrap, step-up correction, frontier and evidence labels against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import evaluation, frontier, inference


def test_weights_follow_the_poisson_distribution():
    w = inference.weights(np.arange(20_000), 50)
    for k in range(5):
        assert np.mean(w == k) == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.03


def test_bootstrap_is_the_same_for_any_partitioning_and_equals_numpy(spark):
    rng = random.Random(4)
    rows = [(c, i, rng.random(), rng.random() + shift) for c, n, shift in (("x", 400, 0.2), ("y", 60, 0.0), ("one", 1, 0.5)) for i in range(n)]
    rows += [("x", 1000, None, 1.0), ("x", None, 1.0, 1.0), (None, 1, 1.0, 1.0), ("nothing", 1, None, None), ("x", 5, 0.1, 0.9), ("x", 5, 0.1, 0.9)]
    df = spark.createDataFrame(rows, "comparison string, case_id bigint, a double, b double")
    got = {r["comparison"]: r for r in inference.paired_bootstrap(df.repartition(7)).collect()}
    again = {r["comparison"]: r for r in inference.paired_bootstrap(df.coalesce(1)).collect()}
    assert got.keys() == again.keys() == {"x", "y", "one"}
    for c, r in got.items():
        own = [(i, b - a) for k, i, a, b in rows if k == c and None not in (i, a, b)]
        w = inference.weights(np.array([i for i, _ in own]), inference.REPLICATES)
        total = w.sum(axis=0)
        means = (np.array([d for _, d in own]) @ w)[total > 0] / total[total > 0]
        p = min(1.0, 2 * (min((means <= 0).sum(), (means >= 0).sum()) + 1) / (len(means) + 1))
        want = (len(own), np.mean([d for _, d in own]), np.quantile(means, 0.025), np.quantile(means, 0.975), p)
        assert tuple(r)[1:6] == pytest.approx(want) and tuple(again[c])[1:] == pytest.approx(tuple(r)[1:])
    assert got["x"]["low"] > 0 and got["x"]["q_value"] < 0.05 < got["y"]["q_value"]
    assert inference.paired_bootstrap(df.limit(0)).count() == 0


def test_step_up_with_ties_and_missing_values(spark):
    values = [0.01, 0.02, 0.02, 0.9, 0.04, None, 1.0, 0.011]
    df = spark.createDataFrame(list(enumerate(values)), "k int, p double")
    got = {r["k"]: r["q"] for r in inference.step_up(df, "p", "q").collect()}
    known = sorted(p for p in values if p is not None)
    for k, p in enumerate(values):
        want = None if p is None else min(1.0, min(x * len(known) / (i + 1) for i, x in enumerate(known) if x >= p))
        assert got[k] == (want if want is None else pytest.approx(want))


def test_frontier_and_area_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(g, i, float(rng.randrange(40)), rng.randrange(30) / 10) for g, n in ((1, 300), (2, 5), (None, 40)) for i in range(n)]
    rows += [(3, 1, 2.0, 0.5), (3, 2, 2.0, 0.5), (4, 1, None, 1.0), (4, 2, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, id int, cost double, quality double").repartition(6)
    usable = [r for r in rows if None not in r[2:]]
    beats = lambda o, r: o[0] == r[0] and o[2] <= r[2] and o[3] >= r[3] and (o[2] < r[2] or o[3] > r[3] or o[1] < r[1])
    want = {r for r in usable if not any(beats(o, r) for o in usable)}
    assert {tuple(r) for r in frontier.frontier(df, "g", "id").collect()} == want
    areas = {r["g"]: r for r in frontier.quality_cost_area(df, "g", "id").collect()}
    assert areas.keys() == {1, 2, 3, None} and areas[3]["area"] == 0.5
    front = sorted((r[2], r[3]) for r in want if r[0] == 1)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(front, front[1:], strict=False)) / (front[-1][0] - front[0][0])
    assert areas[1]["area"] == pytest.approx(area) and areas[1]["n_frontier"] == len(front)


def test_cost_rollup_without_good_runs(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", None, False), ("b", 3.0, False)], "k string, c double, ok boolean")
    got = {r["k"]: tuple(r)[1:] for r in frontier.cost_rollup(df, ["k"], F.col("c"), F.col("ok")).collect()}
    assert got == {"a": (2, 1.0, 0.5, 1.0), "b": (1, 3.0, 0.0, None)}


def test_evidence_scores_of_empty_and_repeated_labels(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, None)], "question int, stage string")
    label = lambda rows: spark.createDataFrame(rows, "question int, label string")
    predicted = label([(1, "C1"), (1, "C1"), (1, "C2"), (3, "C9"), (9, "C1"), (None, "C1"), (5, None)])
    gold = label([(1, "C2"), (1, "C3"), (1, "C3"), (2, "C1"), (9, "C1")])
    got = {(r["stage"], r["scope"]): tuple(r)[2:] for r in evaluation.evidence_scores(questions, predicted, gold, "stage").collect()}
    # question 1: one of two is right; 2: nothing found; 3: nothing to find; 4 and 5: rightly empty
    assert got[("a", "group")] == pytest.approx((2, 0.25, 0.25, 0.25, 0.5, 1 / 3, 0.4))
    assert got[("b", "group")] == pytest.approx((2, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0))
    assert got[(None, "group")] == pytest.approx((1, 1, 1, 1, 1, 1, 1))
    assert got[(None, "all")] == pytest.approx((5, 0.5, 0.5, 0.5, 1 / 3, 1 / 3, 1 / 3))
