"""Answer quality: score, level, signals, gaps and next actions of every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import rules as R
from inkwell.functions import text as T

STRONG, USABLE = 0.35, 0.18
# Fixed value: the text shown for an empty scope.
NO_ASSETS = "- no assets yet"


def is_restrictive(text: Column) -> Column:
    """Text that leaks an internal failure instead of answering."""
    return T.contains_any(text, R.RESTRICTIVE_TERMS)


def level(score: Column) -> Column:
    return F.when(score >= 4.25, "high").when(score >= 3.25, "medium").when(score >= 2.0, "low").otherwise("failing")


def trace_counts(trace: DataFrame) -> DataFrame:
    """Per run: steps, failed steps, fallback steps. Words in the summary count like a status."""
    summary = F.coalesce("summary", F.lit(""))
    failed = (
        ~F.col("status").isin("completed", "skipped")
        | F.contains(summary, F.lit("失败"))
        | F.contains(F.lower(summary), F.lit("failed"))
    )
    fallback = (
        F.contains(F.lower("step_id"), F.lit("fallback"))
        | F.contains(F.lower("title"), F.lit("fallback"))
        | F.contains(summary, F.lit("兜底"))
    )
    return trace.groupBy("run_id").agg(
        F.count("*").alias("n_steps"),
        F.count_if(failed).alias("n_failed"),
        F.count_if(fallback).alias("n_fallback"),
    )


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("run_id").agg(F.count("*").alias("n_evidence"), F.max("score").alias("top_score"))


def citation_counts(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations per run and how many of their labels no evidence row carries."""
    known = evidence.select("run_id", "label").distinct().withColumn("known", F.lit(True))
    return citations.join(known, ["run_id", "label"], "left").groupBy("run_id").agg(
        F.count("*").alias("n_citations"), F.count_if(F.col("known").isNull()).alias("n_unknown")
    )


def score_answers(
    runs: DataFrame, trace: DataFrame, evidence: DataFrame, citations: DataFrame, memory: DataFrame | None = None
) -> DataFrame:
    """Quality report per run of ``runs(run_id, answer, solver_summary, replan_count)``.

    ``trace(run_id, step_id, title, status, summary)``, ``evidence(run_id, label, score)``,
    ``citations(run_id, label)``, ``memory(run_id, n_updates)``.
    """
    joined = (
        runs.join(trace_counts(trace), "run_id", "left")
        .join(evidence_counts(evidence), "run_id", "left")
        .join(citation_counts(citations, evidence), "run_id", "left")
    )
    joined = joined.join(memory, "run_id", "left") if memory is not None else joined.withColumn("n_updates", F.lit(0))
    counts = ["n_steps", "n_failed", "n_fallback", "n_evidence", "n_citations", "n_unknown", "n_updates", "replan_count"]
    facts = joined.na.fill(0, counts).withColumn("_answer", T.strip(F.coalesce("answer", F.lit(""))))

    answer = F.col("_answer")
    answered, traced = answer != "", F.col("n_steps") > 0
    summarised = F.coalesce("solver_summary", F.lit("")) != ""
    found, cited = F.col("n_evidence") > 0, F.col("n_citations") > 0
    failed, restrictive, fell_back = F.col("n_failed") > 0, is_restrictive(answer), F.col("n_fallback") > 0
    matching = cited & (F.col("n_unknown") == 0)
    top = F.col("top_score")
    short = answered & (F.length(answer) < 20)

    def counted(name: str, column: str) -> Column:
        return F.concat(F.lit(name + ":"), F.col(column).cast("string"))

    # (holds, points, signal, gap, next action) in report order
    checks = [
        (answered, 1.0, F.lit("answer_present"), None, None),
        (~answered, 0.0, None, F.lit("empty_answer"), "retry_with_clearer_final_synthesis"),
        (traced, 0.8, counted("trace_steps", "n_steps"), None, None),
        (~traced, 0.0, None, F.lit("missing_execution_trace"), "record_plan_act_observe_trace"),
        (summarised, 0.4, F.lit("solver_summary_present"), None, None),
        (~summarised, 0.0, None, F.lit("missing_solver_summary"), None),
        (failed, 0.0, None, counted("failed_steps", "n_failed"), "inspect_failed_tools_and_retry_with_fallback"),
        (~failed, 0.5, F.lit("no_failed_trace_steps"), None, None),
        (found, 1.0, counted("evidence_items", "n_evidence"), None, None),
        (found & (top >= STRONG), 0.4, F.lit("strong_top_evidence"), None, None),
        (found & (top < STRONG) & (top >= USABLE), 0.2, F.lit("usable_top_evidence"), None, None),
        (found & (top < USABLE), 0.0, None, F.lit("weak_top_evidence"), "broaden_or_refine_retrieval_queries"),
        (~found, 0.0, None, F.lit("no_retrieved_evidence"), "import_relevant_assets_or_use_verified_live_tool"),
        (cited, 1.0, counted("citations", "n_citations"), None, None),
        (matching, 0.3, F.lit("citations_match_evidence"), None, None),
        (cited & ~matching, 0.0, None, F.lit("citation_label_not_in_evidence"), "rebuild_citations_from_retrieved_evidence"),
        (~cited & found, 0.0, None, F.lit("retrieved_evidence_not_cited"), "cite_supporting_evidence_or_mark_answer_uncited"),
        (~cited & ~found, 0.0, None, F.lit("uncited_answer"), None),
        (found & cited & answered, 0.5, F.lit("grounded_answer"), None, None),
        (F.col("replan_count") > 0, 0.0, counted("replan_count", "replan_count"), None, None),
        (restrictive, -1.0, None, F.lit("restrictive_fallback_text"), "replace_internal_failure_text_with_user_facing_answer_or_error"),
        (fell_back, 0.0, None, counted("fallback_steps", "n_fallback"), "rerun_with_more_specific_context_or_verified_sources"),
        (short, -0.3, None, F.lit("very_short_answer"), "expand_answer_with_key_reasoning_and_next_step"),
        (F.col("n_updates") > 0, 0.2, counted("memory_updates", "n_updates"), None, None),
    ]
    score = F.lit(0.0)
    for holds, points, *_ in checks:
        if points:
            score = score + F.when(holds, F.lit(points)).otherwise(F.lit(0.0))

    def listed(position: int) -> Column:
        picked = [F.when(c[0], c[position] if isinstance(c[position], Column) else F.lit(c[position])) for c in checks if c[position] is not None]
        return F.array_distinct(F.array_compact(F.array(*picked)))

    used_fallback = restrictive | fell_back
    rounded = F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), score)), 2)
    actions = listed(4)
    return facts.select(
        "run_id",
        rounded.alias("score"),
        "n_evidence",
        "n_citations",
        F.length(answer).alias("answer_length"),
        (found & cited & answered & ~used_fallback).alias("grounded"),
        used_fallback.alias("fallback_used"),
        listed(2).alias("signals"),
        listed(3).alias("gaps"),
        F.when(F.size(actions) > 0, actions)
        .otherwise(T.lits(["continue_with_follow_up_or_expand_from_current_citations"]))
        .alias("next_actions"),
    ).withColumn("level", level(F.col("score")))


def needs_direct_answer(answer: Column, n_evidence: Column, observation_errors: Column) -> Column:
    """An agent answer that needs the fallback: empty, restrictive, or only failed observations and no evidence.

    ``observation_errors`` is an array of booleans, one per observation.
    """
    empty = (T.strip(F.coalesce(answer, F.lit(""))) == "") | is_restrictive(answer)
    all_failed = (F.size(observation_errors) > 0) & F.forall(observation_errors, lambda e: e)
    return empty | ((n_evidence == 0) & all_failed)


# --- text layouts -------------------------------------------------------------------


def _lines(rows: DataFrame, key: str, order: str, line: Column, name: str, separator: str = "\n", limit: int | None = None) -> DataFrame:
    if limit is not None:
        rows = rows.where(F.col(order) <= limit)
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["line"]), separator).alias(name))


def evidence_brief(evidence: DataFrame, key: str = "run_id", limit: int = 5) -> DataFrame:
    """Labelled blocks of the first ``limit`` evidence rows (``rank`` from 1)."""
    line = F.concat(
        F.lit("["), F.col("label"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("snippet"), F.lit("\nsource="), F.col("source_path")
    )
    return _lines(evidence, key, "rank", line, "evidence_brief", limit=limit)


def evidence_lines(evidence: DataFrame, key: str = "run_id", limit: int = 3, bullet: str = "- ") -> DataFrame:
    line = F.concat(F.lit(f"{bullet}["), F.col("label"), F.lit("] "), F.col("title"), F.lit(": "), F.col("snippet"))
    return _lines(evidence, key, "rank", line, "evidence_lines", limit=limit)


def plan_text(tasks: DataFrame, key: str = "run_id") -> DataFrame:
    """Numbered plan lines of ``tasks(…, task_no, title, goal, depends_on, output_key)``."""
    deps = F.when(F.size("depends_on") > 0, F.concat(F.lit(" | deps="), F.array_join("depends_on", ","))).otherwise(F.lit(""))
    output = F.when(F.coalesce("output_key", F.lit("")) != "", F.concat(F.lit(" | output="), F.col("output_key"))).otherwise(F.lit(""))
    line = F.concat(F.col("task_no").cast("string"), F.lit(". "), F.col("title"), F.lit(": "), F.col("goal"), deps, output)
    return _lines(tasks, key, "task_no", line, "plan_text")


def trace_text(trace: DataFrame, key: str = "run_id", limit: int | None = None) -> DataFrame:
    line = F.concat(
        F.col("step_no").cast("string"), F.lit(". ["), F.col("action"), F.lit("] "), F.col("title"), F.lit(": "), F.col("summary")
    )
    return _lines(trace, key, "step_no", line, "trace_text", limit=limit)


def answer_text(query: Column, plan_summary: Column, plan: Column, trace: Column, evidence: Column) -> Column:
    """Deterministic answer layout; empty blocks get their stand-ins."""

    def block(value: Column, stand_in: str) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.lit(stand_in))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("问题："), query), F.lit(""), F.lit("计划："), block(plan_summary, "按当前上下文直接求解。"),
        block(plan, "1. 直接回答"), F.lit(""), F.lit("执行："), block(trace, "1. 直接回答"), F.lit(""), F.lit("结论："),
        F.lit("当前已完成项目级检索，并整理出可用证据。"), F.lit(""), F.lit("关键依据："), block(evidence, "- 当前没有命中文档证据。"),
        F.lit(""), F.lit("下一步建议："), F.lit("- 继续补充全局知识库中的论文、代码说明或笔记。"),
        F.lit("- 结合当前项目的情景记忆与语义记忆继续追问。"),
    )


def agent_answer(final_text: Column, observations: Column, labels: Column) -> Column:
    """Agent answer: the final text, else the last three observations and the first three labels."""
    seen = F.array_join(F.reverse(F.slice(F.reverse(observations), 1, 3)), "\n\n")
    observed = F.when(F.size(observations) > 0, seen).otherwise(F.lit("当前没有足够的工具观察结果。"))
    cited = F.when(
        F.size(labels) > 0, F.concat(F.lit("\n\n引用："), F.array_join(F.slice(labels, 1, 3), ", "))
    ).otherwise(F.lit(""))
    final = T.strip(F.coalesce(final_text, F.lit("")))
    return F.when(final != "", final).otherwise(F.concat(F.lit("Agent 已完成多步工具调用。\n\n"), observed, cited))


def asset_scope(assets: DataFrame, limit: int = 8) -> DataFrame:
    """One row: ``asset_scope``, the newest ``limit`` assets as a list (equal times: smaller id first), and ``n_assets``, all of them."""
    newest = assets.orderBy(F.col("updated_at").desc(), "asset_id").limit(limit)
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("asset_type"), F.lit(")"))
    items = F.array_sort(F.collect_list(F.struct((-F.unix_micros("updated_at")).alias("at"), "asset_id", line.alias("line"))))
    text = F.array_join(F.transform(items, lambda x: x["line"]), "\n")
    listed = newest.agg(F.when(F.count(F.lit(1)) == 0, NO_ASSETS).otherwise(text).alias("asset_scope"))
    return listed.withColumn("n_assets", assets.agg(F.count(F.lit(1)).alias("n")).scalar())


def packed_context(parts: dict[str, Column]) -> Column:
    """Headed blocks in the given order, separated by empty lines."""
    pieces = []
    for heading, body in parts.items():
        pieces += [F.lit(f"## {heading}"), body]
    return F.concat_ws("\n\n", *pieces)
