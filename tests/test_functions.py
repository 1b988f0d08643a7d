import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.functions import decisions as D
from inkwell.functions import models
from inkwell.functions import rewrite as W
from inkwell.functions import routing as RT
from inkwell.functions import text as T
from inkwell.operators import evaluation as E
from inkwell.operators import evidence as V
from inkwell.operators import memory as M
from inkwell.operators import quality as Q
from inkwell.operators import uploads as U
from inkwell.operators import workspace as WS


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_text_helpers(spark):
    assert one(spark, "chunk-1", T.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk-1"))
    assert one(spark, " Étude: A/B! ", T.slug) == "étude-a-b"
    assert one(spark, "??", T.slug) == "chunk" and one(spark, "??", T.key_slug) == "item"
    assert one(spark, "  ", T.compact_named) == "未命名" and one(spark, "  ", T.compact) == ""
    assert one(spark, "B a b A 语义x语", T.tokenize) == ["语义", "语", "b", "a", "x"]
    assert one(spark, " ?? ", T.bm25_tokens) == ["??"] and one(spark, "", T.bm25_tokens) == ["__empty__"]
    assert one(spark, "a\\b/c.tar.GZ", T.file_suffix) == ".gz" and one(spark, "d/.hidden", T.file_suffix) == ""
    assert one(spark, "a/b.tar.gz", T.file_stem) == "b.tar" and one(spark, "x/ we ird?.md", T.safe_object_name) == "we_ird_.md"
    assert one(spark, " ABCDEF0123456789abcdef0123456789 ", T.normalized_md5) == "abcdef0123456789abcdef0123456789"
    assert one(spark, "zz", T.normalized_md5) is None
    assert one(spark, "l1\n l2 \n\n\n p2", T.page_text) == "l1 l2\n\np2"


def test_rewrite_intents_and_switches(spark):
    ask = lambda rows: spark.createDataFrame(rows, "query_id int, query string, subject string")
    full = W.rewrite_queries(ask([(1, "低信噪比时 DeepSC 为什么还能保住句子意思？", "DeepSC 文本系统")])).orderBy("query_no").collect()
    assert full[0].query == "低信噪比时 DeepSC 为什么还能保住句子意思？"
    assert {r.strategy for r in full} >= {"baseline_expansion", "step_back", "lexical_domain_expansion", "hyde"}
    assert any("低SNR" in r.query for r in full)
    lookup = W.rewrite_queries(ask([(1, "《Adaptive Speech》这篇论文的第一作者是谁", "x")])).collect()
    assert {r.intent for r in lookup} == {"lookup"} and not any(r.strategy == "hyde" for r in lookup)
    assert any("作者" in r.query for r in lookup)
    off = ask([(1, "它未来怎么发展？", "语义通信")])
    assert {r.strategy for r in W.rewrite_queries(off, Settings(rewrite_enabled=False)).collect()} == {"baseline"}
    some = {r.strategy for r in W.rewrite_queries(off, Settings(hyde_enabled=False, step_back_enabled=False)).collect()}
    assert some == {"baseline_expansion", "standalone", "lexical_domain_expansion"}


def test_memory_terms_and_focus(spark):
    terms = one(spark, "语义通信 DeepSC 是什么", W.memory_terms)
    assert "语义通信" in terms and "语义" in terms and "deepsc" in terms and "是什么" not in terms
    lines = spark.createDataFrame(
        [(1, "语义通信 进展", 0, 1, "- a: 语义通信 做了"), (1, "语义通信 进展", 1, 1, "- b: 无关"), (2, "刚才说了什么", 0, 1, "- x"), (3, "qq", 0, 1, "- y")],
        "query_id int, query string, layer int, line_no int, line string",
    )
    got = {r.query_id: (r.text, r.n_lines) for r in M.focused_lines(lines).collect()}
    assert got[1] == ("### Relevant Working Memory\n- a: 语义通信 做了", 1)
    assert got[2] == ("### Relevant Working Memory\n- x", 1)
    assert got[3] == ("没有找到与“qq”直接相关的项目记忆。", 0)


def test_actions_after_tools(spark):
    df = spark.createDataFrame(
        [("北京天气，创建 TODO 带伞", ["weather_lookup"]), ("北京天气", ["weather_lookup"]), ("北京天气", [])], "q string, called array<string>"
    )
    assert [r[0] for r in df.select(RT.next_action(F.col("q"), F.col("called"))).collect()] == ["todo_create", "final_answer", "weather_lookup"]
    assert one(spark, "今天苏州的天气", RT.unresolved_place) in ("苏州", "今天苏州")
    assert one(spark, "1+2 和 10*20", RT.arithmetic_expression) == "10*20"


def test_decisions(spark):
    records = spark.createDataFrame(
        [(1, "c", '{"action":"weather","arguments":{"query":"a  b"}}'), (2, "c", '{"action":"final_answer","arguments":{}}'), (3, "c", '{"action":"memory_write","arguments":{"importance":0.8}}')],
        "id int, category string, expected string",
    )
    predictions = spark.createDataFrame(
        [(1, "s", '```json\n{"action":"weather_lookup","arguments":{"query":"a b"}}\n```'), (2, "s", "{bad} {\"action\":\"rag\",\"arguments\":{}} x}"), (3, "s", "not json")],
        "id int, stage string, prediction string",
    )
    rows = {r.id: r for r in E.judge(records, predictions).collect()}
    assert rows[1].arguments_match and rows[1].predicted_action == "weather_lookup"
    assert rows[2].predicted_action == "local_rag_search" and not rows[2].action_match
    assert rows[3].predicted_action == "invalid_json" and not rows[3].valid_json
    m = E.decision_metrics(E.judge(records, predictions), ["stage"]).first()
    assert m.total == 3 and m.over_tool_rate == 1.0 and m.action_accuracy == pytest.approx(1 / 3)


def test_quality_extremes(spark):
    runs = spark.createDataFrame([("r1", "x" * 30, "done", 0), ("r2", "", None, 0)], "run_id string, answer string, solver_summary string, replan_count int")
    trace = spark.createDataFrame([("r1", "step-1", "t", "completed", "ok")], "run_id string, step_id string, title string, status string, summary string")
    ev = spark.createDataFrame([("r1", "C1", 0.9)], "run_id string, label string, score double")
    cites = spark.createDataFrame([("r1", "C1")], "run_id string, label string")
    mem = spark.createDataFrame([("r1", 2)], "run_id string, n_updates int")
    got = {r.run_id: r for r in Q.score_answers(runs, trace, ev, cites, mem).collect()}
    assert got["r1"].score == 5.0 and got["r1"].level == "high" and got["r1"].grounded
    assert got["r1"].next_actions == ["continue_with_follow_up_or_expand_from_current_citations"]
    assert got["r2"].score == 0.5 and got["r2"].level == "failing" and "empty_answer" in got["r2"].gaps


def test_uploads_resume_and_sizes(spark):
    req = spark.createDataFrame([("a" * 32, "f", 24, 8), ("b" * 32, "g", 20, 8)], "file_md5 string, filename string, file_size long, chunk_size long")
    ups = U.register_uploads(req)
    parts = spark.createDataFrame([("a" * 32, 0, 8), ("a" * 32, 2, 8), ("b" * 32, 2, 4), ("b" * 32, 1, 7)], "upload_id string, part_index int, n_bytes long")
    got = {r.upload_id[0]: (r.missing, r.complete) for r in U.completeness(parts, ups).collect()}
    assert got == {"a": ([1], False), "b": ([0, 1], False)}
    again = spark.createDataFrame([("a" * 32, "a" * 32, 25)], "upload_id string, file_md5 string, file_size long")
    assert U.resume_problems(again, ups).first().mismatches == ["file_size"]


def test_validation_and_checks(spark):
    rows = spark.createDataFrame([("", 1), ("q", 0), ("q", 1)], "user_query string, sequence_id int")
    assert [r.violations for r in WS.validate(rows, WS.turn_rules()).collect()] == [["query_empty"], ["sequence_positive"], []]
    runs = spark.createDataFrame([("s", 2)], "session_id string, sequence_id int")
    assert WS.sequence_violations(runs).first().violation == "gap"


def test_model_functions(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "t string")

    def make():
        def predict(texts):
            return np.array([[float(len(t)), 0.0] for t in texts], dtype="float32")

        return predict

    assert all(r.vector == [1.0, 0.0] for r in models.embed(df, "t", make).collect())
    limits = spark.createDataFrame([(512, None, None), (1024, 1e30, 512), (1024, 256.0, 512), (8, None, None)], "a long, b double, c long")
    got = limits.select(models.effective_max_length(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [int(r[0]) for r in got] == [512, 512, 256, 32]


def test_layouts(spark):
    ev = spark.createDataFrame([("r", 1, "C1", "T", "S", "/p"), ("r", 2, "C2", "U", "V", "/q")], "run_id string, rank int, label string, title string, snippet string, source_path string")
    assert Q.evidence_brief(ev).first().evidence_brief == "[C1] T\nS\nsource=/p\n[C2] U\nV\nsource=/q"
    assert Q.evidence_lines(ev, limit=1).first().evidence_lines == "- [C1] T: S"
    df = spark.createDataFrame([("", ["a", "b", "c", "d"], ["C1"])], "f string, o array<string>, l array<string>")
    assert df.select(Q.agent_answer(F.col("f"), F.col("o"), F.col("l"))).first()[0] == "Agent 已完成多步工具调用。\n\nb\n\nc\n\nd\n\n引用：C1"
    again = V.relabel(spark.createDataFrame([("r", 2, 1, "x"), ("r", 1, 1, "y")], "run_id string, step int, place int, label string"), "run_id", ["step", "place"])
    assert {(r.step, r.label) for r in again.collect()} == {(1, "C1"), (2, "C2")}
    reply = D.truthy(F.lit("Off"))
    assert spark.range(1).select(reply).first()[0] is False


def test_cut_forms_equal_the_forms_of_the_whole_text(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choices("aB9. -_\n語éΣσΆ'\u0301İ😀", k=rng.randrange(200))) for _ in range(2000)] + [" " * 500 + "late", "-" * 900 + "x y", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text, limit = F.col("t"), 9
    dashed = F.btrim(F.regexp_replace(F.lower(T.strip(text)), r"[^\p{L}\p{N}_]+", "-"), F.lit("-"))
    scored = F.btrim(F.regexp_replace(F.lower(T.strip(text)), "[^a-zA-Z0-9\u4e00-\u9fff]+", "_"), F.lit("_"))
    named = T.strip(T.clip(T.collapse_spaces(text), limit))
    whole = {
        "slug": F.when(T.clip(dashed, limit) == "", F.lit("chunk")).otherwise(T.clip(dashed, limit)),
        "key_slug": T.clip(F.when(scored == "", F.lit("item")).otherwise(scored), limit),
        "compact": T.clip(T.collapse_spaces(text), limit),
        "compact_named": F.when(named == "", F.lit(T.UNNAMED)).otherwise(named),
    }
    for name, form in whole.items():
        assert df.where(~getattr(T, name)(text, limit).eqNullSafe(form)).collect() == [], name


def test_a_cut_form_leaves_most_of_a_long_text_alone(spark):
    long = spark.range(1).select(F.repeat(F.concat_ws(" ", F.lit("Some words"), F.col("id")), 400_000).alias("t")).cache()
    long.count()
    took = []
    for form in (T.slug(F.col("t")), F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}_]+", "-")):
        start = time.perf_counter()
        assert long.select(F.length(form).alias("n")).first()[0] >= 72
        took.append(time.perf_counter() - start)
    assert took[0] < took[1]
