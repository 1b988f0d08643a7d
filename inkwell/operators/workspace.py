"""Relational jobs over workspace tables: listings, counts, checks, cascades, run persistence, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T

DEFAULT_SESSION_TITLE = "新会话"


def listing(df: DataFrame, parent: str, order: list[Column], where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Ordered rows per parent; with a limit, the first rows of every parent."""
    from inkwell.operators.segments import newest

    rows = df if where is None else df.where(where)
    if limit is not None:
        rows = newest(rows, [parent], order, limit, "place")
    return rows.orderBy(parent, *order)


def first_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Top rows of the whole table (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(limit)


def with_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Adds ``<name>`` counts of child tables that carry ``key``; children are counted before the join."""
    out = parents
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def missing_parent(children: DataFrame, parents: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose reference (all columns of ``on``: child → parent) has no parent row. NULL means no reference."""
    present = children
    for column in on:
        present = present.where(F.col(column).isNotNull())
    keys = parents.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    return present.join(keys, list(on), "left_anti")


def sequence_violations(runs: DataFrame, key: str = "session_id", seq: str = "sequence_id") -> DataFrame:
    """Rows that break contiguity: not 1 and without predecessor, or more than one row for a number.

    An equi-join on (session, number) instead of a window: no session is ever sorted in one task.
    """
    counts = runs.groupBy(key, seq).agg(F.count("*").alias("n"))
    previous = counts.select(key, (F.col(seq) + 1).alias(seq), F.lit(True).alias("has_previous"))
    checked = counts.join(previous, [key, seq], "left")
    return checked.select(
        key,
        seq,
        F.when(F.col("n") > 1, "duplicate")
        .when((F.col(seq) != 1) & F.col("has_previous").isNull(), "gap")
        .alias("violation"),
    ).where(F.col("violation").isNotNull())


# --- deletes -------------------------------------------------------------------------


def drop_children(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def delete_projects(deleted: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table that carries ``project_id`` without the deleted projects; global tables (assets) stay."""
    return {
        name: drop_children(df, deleted, "project_id") if "project_id" in df.columns else df for name, df in tables.items()
    }


def delete_sessions(
    deleted: DataFrame, sessions: DataFrame, runs: DataFrame, working: DataFrame, todos: DataFrame
) -> dict[str, DataFrame]:
    """Sessions, their runs and working rows go; to-dos that point at a deleted run lose the pointer."""
    gone = runs.join(deleted.select("session_id").distinct(), "session_id", "left_semi").select(
        F.col("run_id").alias("last_run_id"), F.lit(True).alias("_gone")
    )
    freed = todos.join(gone, "last_run_id", "left").withColumn(
        "last_run_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("last_run_id"))
    )
    return {
        "sessions": drop_children(sessions, deleted, "session_id"),
        "runs": drop_children(runs, deleted, "session_id"),
        "working": drop_children(working, deleted, "session_id"),
        "todos": freed.select(*todos.columns),
    }


# --- runs -----------------------------------------------------------------------------


def session_rollup(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Title, summary and last number of every session after its runs were stored."""
    latest = runs.groupBy("session_id").agg(
        F.max("sequence_id").alias("last_sequence_id"),
        F.max_by("answer", "sequence_id").alias("_answer"),
        F.min_by("user_query", "sequence_id").alias("_first"),
        F.min("sequence_id").alias("_min"),
    )
    titled = (F.col("title") == DEFAULT_SESSION_TITLE) & (F.col("_min") == 1)
    return sessions.join(latest, "session_id", "left").select(
        "session_id",
        F.when(titled, T.compact_named(F.col("_first"), 48)).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_answer").isNotNull(), T.compact_named(F.col("_answer"), 160)).otherwise(F.col("summary")).alias("summary"),
        F.coalesce("last_sequence_id", F.lit(0)).alias("last_sequence_id"),
    )


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Persist runs (query, answer, nested payloads) partitioned by day of creation."""
    runs.withColumn("run_date", F.to_date("created_at")).write.mode(mode).partitionBy("run_date").parquet(path)


def append_updates(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Append late memory updates to the ``memory_updates`` array of their run.

    ``updates(project_id, session_id, sequence_id, position, update)``; updates of one run are a handful.
    """
    key = ["project_id", "session_id", "sequence_id"]
    late = updates.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "update"))).alias("_late"))
    return runs.join(late, key, "left").withColumn(
        "memory_updates",
        F.concat("memory_updates", F.coalesce(F.transform("_late", lambda u: u["update"]), F.slice("memory_updates", 1, 0))),
    ).drop("_late")


def run_rollups(trace: DataFrame, evidence: DataFrame) -> DataFrame:
    """Decisions, tool calls, selected tools and evidence kept per run.

    ``trace(run_id, step_no, action, title)``; observations carry the tool in their title.
    """
    observed = F.col("action") == "agent_observation"
    tool = F.regexp_replace(F.col("title"), "^Observation: ", "")
    steps = trace.groupBy("run_id").agg(
        F.count_if(F.col("action") == "agent_decision").alias("n_decisions"),
        F.count_if(observed).alias("n_calls"),
        F.array_sort(F.collect_list(F.when(observed, F.struct("step_no", tool.alias("tool"))))).alias("_tools"),
    )
    kept = evidence.groupBy("run_id").agg(F.count("*").alias("n_evidence"))
    return steps.join(kept, "run_id", "left").select(
        "run_id", "n_decisions", "n_calls", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
        F.transform("_tools", lambda t: t["tool"]).alias("selected_tools"),
    )


def last_entries(history: DataFrame, key: str, order: str, n: int, columns: list[str]) -> DataFrame:
    """The last ``n`` history entries per run, oldest first, as an array of structs."""
    from inkwell.operators.segments import newest

    last = newest(history, [key], [F.col(order).desc()], n)
    return last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("entries"))


# --- plans ------------------------------------------------------------------------------

# Plan templates (task, title, goal, type, depends on, output).
PLANS = {
    "two_stage": (
        ("task-1", "Clarify objective", "明确本轮问题的求解目标与答案类型：{subject}", "scope", (), "objective"),
        ("task-2", "Collect evidence", "根据目标生成检索查询，在全局知识库中收集候选证据。", "retrieve", ("task-1",), "evidence"),
        ("task-3", "Validate and align", "把候选证据与工作记忆、情景记忆、语义记忆对齐，筛掉弱相关材料。", "reason", ("task-2",), "aligned_evidence"),
        ("task-4", "Synthesize answer", "基于对齐后的证据生成带引用答案，并沉淀记忆。", "synthesize", ("task-3",), "final_answer"),
    ),
    "tool_router": (
        ("task-1", "Select skill", "识别问题意图并选择技能：{skill}", "route", (), "selected_skill"),
        ("task-2", "Call live tool", "调用工具 {tool_name} 获取实时或公开数据。", "tool", ("task-1",), "tool_result"),
        ("task-3", "Synthesize answer", "基于工具返回结果生成答案并保留来源。", "synthesize", ("task-2",), "final_answer"),
    ),
    "agent_loop": (
        ("task-1", "Plan next action", "理解用户目标，选择下一步工具或最终回答。", "agent_reason", (), "agent_action"),
        ("task-2", "Execute tool", "按结构化参数调用工具，并记录 observation。", "agent_tool", ("task-1",), "observation"),
        ("task-3", "Decide continuation", "根据 observation 决定继续调用工具、纠错或结束。", "agent_loop", ("task-2",), "next_step"),
        ("task-4", "Final answer", "基于所有工具观察生成最终回答。", "synthesize", ("task-3",), "final_answer"),
    ),
}


def plan_rows(turns: DataFrame, mode: str, completed: bool = False) -> DataFrame:
    """Task rows per turn from the template of ``mode``; ``subject``, ``skill`` and ``tool_name`` fill the goals."""

    def goal(template: str) -> Column:
        text = F.lit(template)
        for name in ("subject", "skill", "tool_name"):
            if "{" + name + "}" in template:
                text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
        return text

    tasks = F.array(
        *[
            F.struct(
                F.lit(i).alias("task_no"), F.lit(task).alias("task_id"), F.lit(title).alias("title"), goal(text).alias("goal"),
                F.lit(kind).alias("task_type"), T.lits(deps).alias("depends_on"), F.lit(output).alias("output_key"),
                F.lit("completed" if completed or (mode == "tool_router" and i == 1) else "pending").alias("status"),
            )
            for i, (task, title, text, kind, deps, output) in enumerate(PLANS[mode], start=1)
        ]
    )
    return turns.select("run_id", F.explode(tasks).alias("t")).select("run_id", "t.*")


# --- validation ---------------------------------------------------------------------------


def length_between(column: str, low: int, high: int | None = None) -> Column:
    n = F.length(F.coalesce(column, F.lit("")))
    return (n >= low) if high is None else n.between(low, high)


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``violations``: the names of rules that do not hold (NULL counts as broken)."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine."""
    clean = F.size("violations") == 0
    return validated.where(clean).drop("violations"), validated.where(~clean)


# Field limits of the workspace tables.
def project_rules() -> dict[str, Column]:
    return {"title_length": length_between("title", 1, 120)}


def asset_rules() -> dict[str, Column]:
    return {"title_length": length_between("title", 1, 120), "content_empty": length_between("content", 1)}


def turn_rules() -> dict[str, Column]:
    return {"sequence_positive": F.col("sequence_id") >= 1, "query_empty": length_between("user_query", 1)}


def variant_rules() -> dict[str, Column]:
    return {"weight_range": F.col("weight").between(0.0, 1.0), "query_empty": length_between("query", 1)}


def upload_rules() -> dict[str, Column]:
    return {
        "filename_length": length_between("filename", 1, 255),
        "size_positive": F.col("file_size") >= 1,
        "md5_format": T.normalized_md5(F.col("file_md5")).isNotNull(),
        "part_size_positive": F.col("chunk_size") >= 1,
    }
