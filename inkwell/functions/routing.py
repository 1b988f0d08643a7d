"""Rule-based routing of a turn: live tools, first action, places, titles, expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import rules as R
from inkwell.functions import text as T

ROUTE_TYPE = "struct<intent:string,skill:string,tool_name:string,reason:string,confidence:double>"


def live_route(query: Column, settings: Settings = DEFAULTS) -> Column:
    """Struct of the live tool to call, NULL for the local path."""
    text = T.strip(query)

    def route(name: str) -> Column:
        intent, skill, tool, confidence, reason = R.ROUTES[name]
        return F.struct(
            F.lit(intent).alias("intent"), F.lit(skill).alias("skill"), F.lit(tool).alias("tool_name"),
            F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"),
        )

    if not settings.live_tools_enabled:
        return F.lit(None).cast(ROUTE_TYPE)
    chain = F.when(T.contains_any(text, R.WEATHER_TERMS), route("weather"))
    if settings.public_web_enabled:
        bound = T.contains_any(text, R.LOCAL_CONTEXT_TERMS) | T.contains_any(text, ("《", "》"))
        chain = chain.when(T.contains_any(text, R.PUBLIC_WEB_TERMS), route("web")).when(
            ~bound & T.contains_any(text, R.GENERAL_PUBLIC_TERMS), route("general")
        )
    return chain


def wants_todo(query: Column, verbs) -> Column:
    return T.contains_any(F.lower(query), R.TODO_WORDS) & T.contains_any(query, verbs)


def wants_memory_write(query: Column) -> Column:
    return T.contains_any(query, R.MEMORY_WRITE_WORDS) & ~T.contains_any(query, R.MEMORY_WRITE_VETO)


def first_action(query: Column) -> Column:
    """Action of a turn without any tool call yet."""
    create = wants_todo(query, R.TODO_CREATE_WORDS)
    return (
        F.when(wants_memory_write(query), F.lit("memory_write"))
        .when(T.contains_any(query, R.MEMORY_READ_WORDS), F.lit("memory_read"))
        .when(wants_todo(query, R.TODO_LIST_WORDS), F.lit("todo_list"))
        .when(create & ~T.contains_any(query, R.OUTING_WORDS), F.lit("todo_create"))
        .when(T.contains_any(query, R.ASSET_WORDS), F.lit("asset_list"))
        .when(F.contains(query, F.lit(R.CALCULATE_WORD)) | query.rlike(r"[0-9]+[ \t\n]*[-+*/%]"), F.lit("calculator"))
        .when(T.contains_any(query, R.AGENT_WEATHER_WORDS), F.lit("weather_lookup"))
        .when(T.contains_any(query, R.AGENT_WEB_WORDS), F.lit("public_web_search"))
        .otherwise(F.lit("local_rag_search"))
    )


def next_action(query: Column, called: Column) -> Column:
    """Action given the tools called so far: a pending to-do after the weather, else the final answer."""
    pending = (
        F.array_contains(called, "weather_lookup")
        & wants_todo(query, R.TODO_CREATE_WORDS)
        & ~F.array_contains(called, "todo_create")
    )
    return (
        F.when(F.size(called) == 0, first_action(query))
        .when(pending, F.lit("todo_create"))
        .otherwise(F.lit(R.FINAL_ACTION))
    )


def todo_title(query: Column) -> Column:
    named = F.regexp_extract(query, "(?:TODO|todo|待办)[：: ]*([^，。；;\n]+)", 1)
    quoted = F.regexp_extract(query, "[“\"]([^”\"]+)[”\"]", 1)
    return T.compact_named(F.when(named != "", named).when(quoted != "", quoted).otherwise(query), 80)


def arithmetic_expression(query: Column) -> Column:
    """Longest run that looks like arithmetic, the first one on ties; the query itself when there is none."""
    found = F.regexp_extract_all(query, F.lit(r"[0-9][0-9 \t\n+\-*/().%]*"), F.lit(0))
    best = F.array_max(F.transform(found, lambda m, i: F.struct(F.length(m).alias("n"), (-i).alias("at"), m.alias("m"))))
    return F.coalesce(T.strip(best["m"]), query)


def place(query: Column, places=R.PLACES) -> Column:
    """First gazetteer entry named in the query, in list order; NULL when there is none."""

    def entry(p):
        name, lat, lon, zone, shown = p
        return F.struct(
            F.lit(shown).alias("name"), F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude"), F.lit(zone).alias("timezone")
        )

    chain = F
    for p in places:
        chain = chain.when(F.contains(query, F.lit(p[0])), entry(p))
    return chain


def unresolved_place(query: Column) -> Column:
    """Name near a weather word for queries without a known place; '' when none is found."""
    cjk = "[一-鿿]{2,8}"
    before = F.regexp_extract(query, f"(?:今天|明天|现在|当前)?({cjk})(?:的)?(?:天气|气温|温度)", 1)
    after = F.regexp_extract(query, f"(?:天气|气温|温度).*?(?:在|查|看)({cjk})", 1)
    return F.btrim(F.when(before != "", before).otherwise(after), F.lit("的在查看"))


def route_turns(turns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``route, action, title, expression, place`` to ``turns(…, query)``."""
    q = F.col("query")
    return turns.select(
        "*",
        live_route(q, settings).alias("route"),
        first_action(q).alias("action"),
        todo_title(q).alias("title"),
        arithmetic_expression(q).alias("expression"),
        place(q).alias("place"),
    )


def planning_features(turns: DataFrame) -> DataFrame:
    """Context features of a turn ``asset_ids, todo_id, session_context, task_state, knowledge_scope``."""
    return turns.select(
        "*",
        (F.size("asset_ids") > 0).alias("has_selected_assets"),
        F.size("asset_ids").alias("selected_asset_count"),
        (F.coalesce("todo_id", F.lit("")) != "").alias("has_todo"),
        T.compact_named(F.col("session_context"), 180).alias("session_context_preview"),
        T.compact_named(F.col("task_state"), 180).alias("task_state_preview"),
        T.compact_named(F.col("knowledge_scope"), 220).alias("knowledge_scope_preview"),
    )


def tool_table(spark) -> DataFrame:
    """The tool registry; a fixed handful of rows, so callers may broadcast it."""
    return spark.createDataFrame(
        [(t, s, i, ro, risk, list(tags)) for t, s, i, ro, risk, tags in R.TOOLS],
        "tool string, skill string, tool_intent string, read_only boolean, risk_level string, tags array<string>",
    )


def skill_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(s, t, list(tags)) for s, t, tags in R.SKILLS], "skill string, skill_title string, skill_tags array<string>"
    )


def with_skill(actions: DataFrame, action: str = "action", read_only_only: bool = False) -> DataFrame:
    """Registry columns of every action; actions outside the registry keep NULLs."""
    spark = actions.sparkSession
    registry = tool_table(spark).join(F.broadcast(skill_table(spark)), "skill")
    if read_only_only:
        registry = registry.where("read_only")
    return actions.join(F.broadcast(registry), F.col(action) == F.col("tool"), "left").drop("tool")
