import json
import math
import re

import pytest
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.operators import dense as D
from inkwell.operators import evidence as V
from inkwell.operators import retrieval as R
from inkwell.workload import rewrite_queries as RQ
from inkwell.workload import retrieval_queries as WQ


def tokens(text):
    found = re.findall("[一-鿿]+", text) + re.findall("[a-zA-Z0-9_./-]+", text.lower())
    return list(dict.fromkeys(found))


def brute_bm25(docs, query, k):
    corpus = {i: tokens(t) or [t.strip().lower() or "__empty__"] for i, t in docs.items()}
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = {}
    for toks in corpus.values():
        for t in toks:
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    scores = {
        i: sum(idf[t] for t in tokens(query) if t in set(toks)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(toks) / avg))
        for i, toks in corpus.items()
    }
    ranked = sorted((i for i in scores if scores[i] > 0), key=lambda i: (-round(scores[i], 9), i))
    return ranked[:k]


def test_bm25_matches_brute_force(spark, sf):
    docs, asked = WQ.document_chunks(spark, sf), WQ.benchmark_queries(spark, sf)
    texts = {r.chunk_id: r.content for r in docs.collect()}
    got = {}
    for r in R.bm25_search(asked, docs, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in asked.collect():
        assert got[q.query_id] == brute_bm25(texts, q.query, 5)


def test_shuffled_path_equals_broadcast_path(spark, sf):
    docs, asked = WQ.document_chunks(spark, sf), WQ.benchmark_queries(spark, sf)
    small = R.pair_scores(asked, docs).drop("bucket")
    large = R.pair_scores(asked, docs, settings=Settings(broadcast_max_rows=10, salt_rows=20)).drop("bucket")
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def test_search_does_not_depend_on_partitions_or_order(spark, sf):
    docs, asked = WQ.document_chunks(spark, sf), WQ.benchmark_queries(spark, sf)
    a = R.hybrid_search(asked, docs).select("query_id", "chunk_id", "rank", "score")
    b = R.hybrid_search(asked.repartition(3), docs.orderBy(F.col("pos").desc()).repartition(7)).select("query_id", "chunk_id", "rank", "score")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_pairs_are_not_shuffled(spark, sf):
    pairs = R.pair_scores(WQ.benchmark_queries(spark, sf), WQ.document_chunks(spark, sf))
    top = R.ranked_lists(pairs, 20)
    plan = top._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[-1]
    # From the scored pairs up to the first local top-k there is no exchange.
    upper = final[: final.index("HashAggregate")]
    assert upper.count("Exchange") == 1


def test_stored_index_reads_no_text(spark, sf, tmp_path):
    asked, docs = WQ.benchmark_queries(spark, sf), WQ.document_chunks(spark, sf)
    R.write_index(docs, str(tmp_path / "index"))
    found = R.hybrid_search(asked, None, 5, index=R.read_index(spark, str(tmp_path / "index")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
    direct = R.hybrid_search(asked, docs, 5)
    assert found.exceptAll(direct).isEmpty() and direct.exceptAll(found).isEmpty()


def test_levels_and_scope(spark):
    chunks = spark.createDataFrame(
        [("c1", 1, "alpha beta", None, "a"), ("c2", 2, "alpha", "parent", "a"), ("c3", 3, "alpha", "child", "b")],
        "chunk_id string, pos long, content string, chunk_level string, asset_id string",
    )
    assert {r.chunk_id for r in R.searchable(chunks).collect()} == {"c1", "c3"}
    scope = spark.createDataFrame([("b",)], "asset_id string")
    assert {r.chunk_id for r in R.in_scope(chunks, scope).collect()} == {"c2", "c3"} - {"c2"}
    assert R.in_scope(chunks, None).count() == 3


def test_dense_blocked_equals_broadcast(spark, sf):
    vectors = WQ.vector_table(spark, sf)
    asked = vectors.select(F.col("chunk_id").alias("query_id"), "vector")
    a = D.dense_topk(asked, vectors, 3)
    b = D.dense_topk(asked, vectors, 3, settings=Settings(dense_block_rows=64))
    cols = ["query_id", "chunk_id", "rank", "score"]
    assert a.select(cols).exceptAll(b.select(cols)).isEmpty()
    # every vector is its own nearest one
    assert a.where("rank = 1 and query_id <> chunk_id and score < 0.999999").isEmpty()


def test_l2_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(D.l2_normalize(F.col("a")).alias("u"), D.cosine(F.col("a"), F.col("a")).alias("c"), D.l2_normalize(F.col("b")).alias("z")).first()
    assert r.u == [0.6, 0.8] and r.c == pytest.approx(1.0) and r.z == [0.0, 0.0]


def test_merge_keeps_best_and_first_place(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1.0, "q1", "a", 1, 1.0), (1, 2, 0.5, "q2", "a", 1, 9.0), (1, 1, 1.0, "q1", "b", 2, 0.995), (1, 2, 0.01, "q2", "c", 2, 1.0)],
        "query_id int, query_no int, weight double, matched_query string, chunk_id string, rank int, score double",
    )
    rows = V.merge_searches(hits, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.matched_query) for r in rows] == [("a", "q2"), ("b", "q1")]
    assert rows[0].score == pytest.approx(9.0 * 0.5 + 0.01 + 0.01)


def test_centered_context(spark):
    parent = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(parent, "w100 w101"), (parent, "absent"), ("short", "x")], "p string, c string")
    a, b, c = [r[0] for r in df.select(V.centered_context(F.col("p"), F.col("c"), 90)).collect()]
    assert a.startswith("...") and a.endswith("...") and "w100 w101" in a
    assert b == parent[:90].strip() and c == "short"


def test_replan_runs_for_weak_queries(spark):
    from inkwell.operators.chunking import chunk_documents

    assets = spark.createDataFrame(
        [("a1", "Paper", "note", "# Intro\nsemantic channel coding helps. More text here.")],
        "asset_id string, title string, asset_type string, content string",
    )
    asked = spark.createDataFrame([(1, "semantic channel coding"), (2, "zzz qqq")], "query_id int, query string")
    chunks = chunk_documents(assets)
    rows = V.retrieve_with_replan(asked, chunks).collect()
    assert {r.query_id for r in rows} == {1}
    assert V.weak_queries(asked, V.retrieve(RQ.W.rewrite_queries(asked), chunks)).collect()[0].query_id == 2
    top = rows[0]
    assert top.label == "C1" and top.title == "Paper · Intro" and top.source_path == "/assets/a1#intro"


def test_topics_of_any_depth(spark):
    nested = {"Text": "leaf", "FirstURL": "u"}
    for depth in range(5):
        nested = {"Name": str(depth), "Topics": [{"Text": f"before {depth}"}, nested]}
    payloads = [(1, "q", json.dumps({"RelatedTopics": [nested]})), (2, "q", "{broken"), (3, "q", None)]
    rows = V.search_result_rows(spark.createDataFrame(payloads, "run_id int, query string, payload string")).orderBy("n").collect()
    assert [r.snippet for r in rows] == [f"before {d}" for d in (4, 3, 2, 1, 0)]
    assert V._leaf_topics(payloads[0][2])[-1] == ("leaf", "u")


def test_rewriting_beats_plain_search_on_golden_questions(spark):
    from inkwell.operators.chunking import chunk_documents
    from inkwell.operators.evaluation import summarize_metrics
    from inkwell.plans import jobs

    assets = spark.createDataFrame(
        [
            ("a1", "Robust sentences", "note", "DeepSC trains a Transformer and reports sentence similarity. 低SNR 语义相似度"),
            ("a2", "Inference at the edge", "note", "DDIB follows the information bottleneck and its rate-relevance tradeoff. 边缘推理"),
            ("a3", "Sending again", "note", "Selective retransmission repeats 错误语义片段 only."),
            ("a4", "Pilots in motion", "note", "A superimposed pilot helps 信道估计 at 高速移动."),
            ("a5", "Attacks", "note", "R-DeepSC meets literal semantic noise with adversarial training."),
            ("d1", "DIST: recipes", "note", "The semantic meaning of a sentence under noise in a kitchen of devices."),
            ("d2", "DIST: planes", "note", "Moving fast, the crew failed; pieces of text on the wing while landing."),
        ],
        "asset_id string, title string, asset_type string, content string",
    )
    golden = [
        (1, "semantic sentence meaning under noise, 低信噪比", "Robust sentences"),
        (2, "semantic tradeoff of 边缘 devices", "Inference at the edge"),
        (3, "semantic 重传 of failed pieces", "Sending again"),
        (4, "semantic 导频 while moving fast", "Pilots in motion"),
        (5, "semantic noise under attack", "Attacks"),
    ]
    cases = spark.createDataFrame(golden, "case_id int, query string, marker string")
    asked = cases.select(F.col("case_id").alias("query_id"), "query")
    full = RQ.W.rewrite_queries(asked)
    strategies = {
        "plain": asked.select("query_id", F.lit(1).alias("query_no"), "query", F.lit(1.0).alias("weight")),
        "three": full.where("query_no <= 3"),
        "full": full,
    }
    rows = jobs.evaluate_retrieval(cases.select("case_id"), cases.select("case_id", "marker"), strategies, chunk_documents(assets))
    got = {r.strategy: r for r in summarize_metrics(rows, ["strategy"]).collect()}
    plain, three, best = got["plain"], got["three"], got["full"]
    assert {r.n_cases for r in got.values()} == {5}
    assert best.hit5 >= plain.hit5 and best.mrr5 > plain.mrr5 and best.coverage5 > plain.coverage5
    assert three.mrr5 >= plain.mrr5 and best.hit1 > plain.hit1
    assert best.drift_rate <= plain.drift_rate and plain.drift_rate > 0
