"""Text layouts, memory terms, features, payloads and evidence rows over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import rewrite as W
from inkwell.functions import routing as RT
from inkwell.functions import rules as R
from inkwell.functions import text as T
from inkwell.operators import alignment as A
from inkwell.operators import evidence as V
from inkwell.operators import quality as Q
from inkwell.operators import retrieval as RV
from inkwell.operators import uploads as U
from inkwell.operators import workspace as WS
from inkwell.session import table
from inkwell.sources import store
from inkwell.workload import memory_queries as MQ
from inkwell.workload import sqltext as S
from inkwell.workload.memory_queries import runs
from inkwell.workload.registry import register

LINE_ITEMS = """ev AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS rank,
    'part ' || l_partkey AS title, l_returnflag || l_linestatus AS snippet FROM lineitem)"""


def line_evidence(spark, sf):
    """Orders stand for runs, their lines for evidence."""
    return V.relabel(
        table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("run_id"), "l_linenumber", F.concat(F.lit("part "), "l_partkey").alias("title"),
            F.concat("l_returnflag", "l_linestatus").alias("snippet"), F.concat(F.lit("/p/"), "l_partkey").alias("source_path"),
            "l_partkey", "l_suppkey", F.col("l_discount").alias("score"),
        ),
        "run_id",
        ["l_linenumber", "l_partkey", "l_suppkey", "score"],
    ).withColumn("rank", F.substring("label", 2, 10).cast("int"))


@register(
    "evidence_lines",
    f"""WITH {LINE_ITEMS} SELECT run_id, string_agg('- [C' || rank || '] ' || title || ': ' || snippet, chr(10) ORDER BY rank) AS evidence_lines
    FROM ev WHERE rank <= 3 GROUP BY run_id""",
)
def evidence_lines(spark, sf):
    return Q.evidence_lines(line_evidence(spark, sf))


@register(
    "evidence_brief",
    """WITH ev AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS rank, l_partkey,
      l_returnflag || l_linestatus AS snippet FROM lineitem)
    SELECT run_id, string_agg('[C' || rank || '] part ' || l_partkey || chr(10) || snippet || chr(10) || 'source=/p/' || l_partkey, chr(10) ORDER BY rank) AS evidence_brief
    FROM ev WHERE rank <= 5 GROUP BY run_id""",
)
def evidence_brief(spark, sf):
    return Q.evidence_brief(line_evidence(spark, sf))


@register(
    "plan_text",
    f"""WITH {MQ.RUNS} SELECT session_id || '-' || sequence_id AS run_id,
      '1. Select skill: 识别问题意图并选择技能：weather_qa | output=selected_skill' || chr(10) ||
      '2. Call live tool: 调用工具 weather_lookup 获取实时或公开数据。 | deps=task-1 | output=tool_result' || chr(10) ||
      '3. Synthesize answer: 基于工具返回结果生成答案并保留来源。 | deps=task-2 | output=final_answer' AS plan_text FROM runs""",
)
def plan_text(spark, sf):
    turns = runs(spark, sf).select(
        F.concat_ws("-", "session_id", F.col("sequence_id").cast("string")).alias("run_id"),
        F.lit("weather_qa").alias("skill"), F.lit("weather_lookup").alias("tool_name"),
    )
    return Q.plan_text(WS.plan_rows(turns, "tool_router"))


@register(
    "answer_layout",
    f"""WITH {MQ.RUNS} SELECT session_id, sequence_id, md5('问题：' || user_query || chr(10) || chr(10) || '计划：' || chr(10) || '按当前上下文直接求解。' || chr(10) ||
      '1. 直接回答' || chr(10) || chr(10) || '执行：' || chr(10) || '1. 直接回答' || chr(10) || chr(10) || '结论：' || chr(10) ||
      '当前已完成项目级检索，并整理出可用证据。' || chr(10) || chr(10) || '关键依据：' || chr(10) || '- [C1] x: ' || answer || chr(10) || chr(10) ||
      '下一步建议：' || chr(10) || '- 继续补充全局知识库中的论文、代码说明或笔记。' || chr(10) || '- 结合当前项目的情景记忆与语义记忆继续追问。') AS digest FROM runs""",
)
def answer_layout(spark, sf):
    text = Q.answer_text(
        F.col("user_query"), F.lit(""), F.lit(None).cast("string"), F.lit(""), F.concat(F.lit("- [C1] x: "), "answer")
    )
    return runs(spark, sf).select("session_id", "sequence_id", F.md5(text).alias("digest"))


@register(
    "direct_answer_check",
    f"""SELECT conv_id, turn, {S.strip('text')} = '' OR {S.contains_any('text', R.RESTRICTIVE_TERMS)} OR
      (turn % 3 = 0 AND length(text) % 2 = 0) AS needed FROM conversations WHERE role = 'assistant'""",
)
def direct_answer_check(spark, sf):
    """Answers with an evidence count and observation errors derived from the turn."""
    answers = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    errors = F.array(F.lit(True), F.length("text") % 2 == 0)
    return answers.select("conv_id", "turn", Q.needs_direct_answer(F.col("text"), F.col("turn") % 3, errors).alias("needed"))


@register(
    "planning_features",
    f"""SELECT conv_id, turn, turn % 2 > 0 AS has_selected_assets, (turn % 2)::BIGINT AS selected_asset_count, role = 'user' AS has_todo,
      {S.compact_named('text', 180)} AS session_context_preview FROM conversations""",
)
def planning_features(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.slice(T.lits(("a",)), 1, (F.col("turn") % 2).cast("int")).alias("asset_ids"),
        F.when(F.col("role") == "user", "todo-1").alias("todo_id"),
        F.col("text").alias("session_context"), F.col("text").alias("task_state"), F.col("text").alias("knowledge_scope"),
    )
    return RT.planning_features(turns).select(
        "conv_id", "turn", "has_selected_assets", F.col("selected_asset_count").cast("bigint").alias("selected_asset_count"), "has_todo",
        "session_context_preview",
    )


@register(
    "memory_line_scores",
    f"""WITH {MQ.RUNS}, t AS (
      SELECT session_id, sequence_id, answer, list_slice(list_filter(list_concat(
        regexp_extract_all(lower(user_query), {S.quoted(T.LATIN_TOKEN)}),
        ['定义', '原理', '应用'], regexp_extract_all(lower({S.compact_named('user_query', 80)} || '{R.CONCEPT_SUFFIX}'), {S.quoted(T.LATIN_TOKEN)}),
        list_transform(regexp_extract_all(user_query, '[一-鿿]{{2,}}|[A-Za-z0-9_./+-]{{2,}}'), lambda x: lower(x))),
        lambda v: length(v) >= 2), 1, 100000) AS raw FROM runs),
    u AS (SELECT *, list_slice(list_filter(raw, lambda v, i: list_position(raw, v) = i), 1, 24) AS terms FROM t)
    SELECT session_id, sequence_id, len(list_filter(terms, lambda v: contains(lower(answer), v)))::DOUBLE AS score FROM u""",
)
def memory_line_scores(spark, sf):
    """How many terms of a question its answer repeats."""
    scored = runs(spark, sf).select("session_id", "sequence_id", "answer", W.memory_terms(F.col("user_query")).alias("terms"))
    return scored.select("session_id", "sequence_id", W.memory_line_score(F.col("terms"), F.col("answer")).alias("score"))


@register(
    "fact_payloads",
    f"""WITH {MQ.FACTS} SELECT id AS fact_id, fact_type || ':' || memory_key AS title, statement AS content, session_id FROM facts""",
)
def fact_payloads(spark, sf):
    return store.fact_payload(MQ.facts(spark, sf)).select("fact_id", "title", "content", "session_id")


@register(
    "note_rows",
    f"""SELECT conv_id, turn, {S.compact_named("CASE WHEN turn % 2 = 0 THEN 'agent_note' ELSE 'key ' || turn END", 64)} AS memory_key,
      {S.compact_named('text', 500)} AS content, CASE WHEN turn % 3 = 0 THEN 0.6 WHEN turn % 3 = 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS importance
    FROM conversations WHERE role = 'user'""",
)
def note_rows(spark, sf):
    from inkwell.operators import memory as M

    notes = table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.lit("p").alias("project_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("session_id"),
        F.lit(1).alias("sequence_id"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("key "), "turn")).alias("key"),
        F.lit("").alias("content"), F.when(F.col("turn") % 3 == 0, "x").when(F.col("turn") % 3 == 1, "7").otherwise("0.25").alias("importance"),
        F.col("text").alias("user_query"),
    )
    parts = F.split("session_id", "-")
    return M.note_rows(notes).select(
        parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"), "memory_key", "content", "importance"
    )


@register(
    "observation_evidence",
    """SELECT user_id::VARCHAR AS run_id, 'C' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS label,
      's' || event_id || ':tool:' || event_type AS chunk_id, substring(props, 1, 320) AS snippet, 'mcp://srv/tool/' || event_type AS source_path FROM events""",
)
def observation_evidence(spark, sf):
    seen = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("step_no"), F.concat(F.lit("s"), "event_id").alias("step_id"),
        F.lit("srv").alias("server"), F.lit("tool").alias("capability_type"), F.col("event_type").alias("name"), F.col("props").alias("content"),
        F.lit("p").alias("project_id"),
    )
    return V.observation_evidence(seen).select("run_id", "label", "chunk_id", "snippet", "source_path")


@register(
    "resume_problems",
    """SELECT md5(o_orderkey::VARCHAR) AS upload_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'file_md5,file_size'
      WHEN o_orderkey % 3 = 0 THEN 'file_md5' ELSE 'file_size' END AS mismatches FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0""",
)
def resume_problems(spark, sf):
    """Stored uploads resumed with another digest or size."""
    key = F.col("o_orderkey")
    digest = F.md5(key.cast("string"))
    stored = table(spark, sf, "orders").select(digest.alias("upload_id"), digest.alias("file_md5"), key.alias("file_size"))
    asked = table(spark, sf, "orders").select(
        digest.alias("upload_id"), F.when(key % 3 == 0, "other").otherwise(digest).alias("file_md5"),
        F.when(key % 4 == 0, key + 1).otherwise(key).alias("file_size"),
    )
    return U.resume_problems(asked, stored).select("upload_id", F.array_join("mismatches", ",").alias("mismatches"))


@register(
    "retrieval_strength",
    """WITH ev AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS rank, l_discount AS score FROM lineitem),
    s AS (SELECT query_id, count(*) AS n_hits, arg_min(score, rank) AS top FROM ev GROUP BY query_id)
    SELECT query_id, n_hits, round(top + 0.05::DOUBLE * least(n_hits, 5), 6) AS strength, top < 0.18 AS weak FROM s""",
)
def retrieval_strength(spark, sf):
    rows = line_evidence(spark, sf).select(F.col("run_id").alias("query_id"), "rank", "score")
    return V.strength(rows).select(
        "query_id", "n_hits", F.round("strength", 6).alias("strength"), (F.col("top_score") < V.GENERAL_THRESHOLD).alias("weak")
    )


@register(
    "model_rerank",
    f"""WITH {S.search_ctes("SELECT doc_id AS chunk_id, doc_id AS pos, text AS content FROM documents",
                           "SELECT item_id AS query_id, text AS query FROM benchmark")},
    sparse AS ({S.top_k('bm25', 20)}),
    scored AS (SELECT query_id, chunk_id, rank AS fused, (chunk_id % 97)::DOUBLE AS score FROM sparse)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused) AS rank FROM scored) WHERE rank <= 5""",
)
def model_rerank(spark, sf):
    """BM25 candidates reordered by scores from outside; here the scores come from the document number."""
    from inkwell.workload.retrieval_queries import benchmark_queries, document_chunks

    hits = RV.bm25_search(benchmark_queries(spark, sf), document_chunks(spark, sf), 20)
    fused = RV.fuse(RV.merge_ranked(hits.limit(0), hits), 20)
    scores = hits.select("query_id", "chunk_id", (F.col("chunk_id") % 97).cast("double").alias("rerank_score"))
    ranked = RV.rerank_by_model(fused, scores, 5)
    return ranked.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@register(
    "split_membership",
    """WITH l AS (SELECT doc_id AS case_id, quality::VARCHAR AS stratum, count(*) OVER (PARTITION BY quality) AS n,
        row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || coalesce(doc_id::VARCHAR, '')), doc_id) AS place FROM labels)
    SELECT case_id, stratum, CASE WHEN place <= least(n - 1, greatest(1, round_even(n * (1.0::DOUBLE - 0.8::DOUBLE), 0)::BIGINT)) THEN 'eval' ELSE 'train' END AS split FROM l""",
)
def split_membership(spark, sf):
    """Which labelled document goes to which split, by the order of their digests."""
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").cast("string").alias("stratum"))
    return A.stratified_split(cases, "stratum")


@register(
    "asset_scope",
    """WITH t AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8)
    SELECT string_agg('- order ' || o_orderkey || ' (' || o_orderstatus || ')', chr(10) ORDER BY o_orderdate DESC, o_orderkey) AS asset_scope,
      (SELECT count(*) FROM orders) AS n_assets FROM t""",
)
def asset_scope(spark, sf):
    """Orders as assets: the newest eight as a list, and the number of all."""
    assets = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"), F.concat(F.lit("order "), "o_orderkey").alias("title"),
        F.col("o_orderstatus").alias("asset_type"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )
    return Q.asset_scope(assets)
