"""Routing, tool decisions and answer quality over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import decisions as D
from inkwell.functions import routing as RT
from inkwell.functions import rules as R
from inkwell.functions import text as T
from inkwell.operators import evaluation as E
from inkwell.operators import quality as Q
from inkwell.plans import jobs
from inkwell.session import table
from inkwell.workload import sqltext as S
from inkwell.workload.registry import register

TURN_FRAMES = (
    "{}", "北京天气怎么样 {}", "请记住 {}", "刚才说了什么 {}", "列出 todo {}", "创建 TODO：{}", "有哪些文档 {}", "计算 12 * (3+4) {}",
    "联网搜索 {}", "{} 是谁", "东京 明天下雨吗 {}", "{} 2+2",
)


def turn_queries(spark: SparkSession, sf: str) -> DataFrame:
    """User turns put into request frames, so that every route occurs."""
    frame = F.element_at(T.lits(TURN_FRAMES), ((F.col("conv_id") + F.col("turn")) % len(TURN_FRAMES) + 1).cast("int"))
    return table(spark, sf, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", F.replace(frame, F.lit("{}"), F.col("text")).alias("query")
    )


_FRAMES = "[" + ", ".join(S.quoted(f) for f in TURN_FRAMES) + "]"
TURNS = f"""turns AS (SELECT conv_id, turn, replace(({_FRAMES})[(conv_id + turn) % {len(TURN_FRAMES)} + 1], '{{}}', text) AS query
    FROM conversations WHERE role = 'user')"""
_BOUND = f"({S.contains_any('query', R.LOCAL_CONTEXT_TERMS)} OR contains(query, '《') OR contains(query, '》'))"
_TODO = S.contains_any("lower(query)", R.TODO_WORDS)
_EXPR = "regexp_extract_all(query, '[0-9][0-9 \\t\\n+\\-*/().%]*')"


@register(
    "route_turns",
    f"""WITH {TURNS} SELECT conv_id, turn,
      CASE WHEN {S.contains_any('query', R.WEATHER_TERMS)} THEN 'weather_lookup'
           WHEN {S.contains_any('query', R.PUBLIC_WEB_TERMS)} THEN 'public_web_search'
           WHEN NOT {_BOUND} AND {S.contains_any('query', R.GENERAL_PUBLIC_TERMS)} THEN 'public_web_search' END AS tool_name,
      CASE WHEN {S.contains_any('query', R.WEATHER_TERMS)} THEN 0.92::DOUBLE
           WHEN {S.contains_any('query', R.PUBLIC_WEB_TERMS)} THEN 0.74::DOUBLE
           WHEN NOT {_BOUND} AND {S.contains_any('query', R.GENERAL_PUBLIC_TERMS)} THEN 0.66::DOUBLE END AS confidence,
      CASE WHEN {S.contains_any('query', R.MEMORY_WRITE_WORDS)} AND NOT {S.contains_any('query', R.MEMORY_WRITE_VETO)} THEN 'memory_write'
           WHEN {S.contains_any('query', R.MEMORY_READ_WORDS)} THEN 'memory_read'
           WHEN {_TODO} AND {S.contains_any('query', R.TODO_LIST_WORDS)} THEN 'todo_list'
           WHEN {_TODO} AND {S.contains_any('query', R.TODO_CREATE_WORDS)} AND NOT {S.contains_any('query', R.OUTING_WORDS)} THEN 'todo_create'
           WHEN {S.contains_any('query', R.ASSET_WORDS)} THEN 'asset_list'
           WHEN contains(query, '计算') OR regexp_matches(query, '[0-9]+[ \\t\\n]*[-+*/%]') THEN 'calculator'
           WHEN {S.contains_any('query', R.AGENT_WEATHER_WORDS)} THEN 'weather_lookup'
           WHEN {S.contains_any('query', R.AGENT_WEB_WORDS)} THEN 'public_web_search'
           ELSE 'local_rag_search' END AS action,
      CASE {' '.join(f"WHEN contains(query, '{p[0]}') THEN '{p[4]}'" for p in R.PLACES)} END AS place,
      {S.compact_named("CASE WHEN regexp_extract(query, '(?:TODO|todo|待办)[：: ]*([^，。；;\n]+)', 1) <> '' THEN regexp_extract(query, '(?:TODO|todo|待办)[：: ]*([^，。；;\n]+)', 1) ELSE query END", 80)} AS title,
      coalesce({S.strip(f"list_extract(list_sort(list_transform({_EXPR}, lambda m, i: {{'n': -length(m), 'i': i, 'm': m}})), 1).m")}, query) AS expression
    FROM turns""",
)
def route_turns(spark, sf):
    routed = RT.route_turns(turn_queries(spark, sf))
    return routed.select(
        "conv_id", "turn", "route.tool_name", "route.confidence", "action", F.col("place.name").alias("place"), "title", "expression"
    )


@register(
    "action_skills",
    f"""WITH {TURNS}, acts AS (SELECT CASE WHEN contains(query, '天气') OR contains(query, '下雨') THEN 'weather_lookup' ELSE 'local_rag_search' END AS action FROM turns)
    SELECT action, skill, read_only, risk_level, count(*) AS n FROM acts JOIN (VALUES
      ('weather_lookup', 'fieldwork_context', true, 'low'), ('local_rag_search', 'project_literature_rag', true, 'low'))
      r(tool, skill, read_only, risk_level) ON tool = action GROUP BY ALL""",
)
def action_skills(spark, sf):
    asked = turn_queries(spark, sf).select(
        F.when(T.contains_any(F.col("query"), ("天气", "下雨")), "weather_lookup").otherwise("local_rag_search").alias("action")
    )
    return RT.with_skill(asked).groupBy("action", "skill", "read_only", "risk_level").agg(F.count("*").alias("n"))


# --- tool decisions: one record per event ---------------------------------------------

EXPECTED = {"view": "local_rag_search", "click": "public_web_search", "signup": "todo_create", "purchase": "calculator", "error": "final_answer"}
SPOKEN = ("rag", "Web_Search", "create_todo", " calculate ", "finish")


def decision_records(spark: SparkSession, sf: str) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    args = F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit(',"answer":"done"}'))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("category"),
        F.concat(F.lit('{"action":"'), mapping[F.col("event_type")], F.lit('","arguments":'), args, F.lit("}")).alias("expected"),
    )


def decision_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of two stages: an alias picked by user, sometimes fenced, sometimes no JSON, sometimes two objects."""
    spoken = F.element_at(T.lits(SPOKEN), (F.col("user_id") % len(SPOKEN) + 1).cast("int"))
    action = F.concat(F.lit('{"action":"'), spoken, F.lit('","arguments":{"value":'))
    value = F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")).cast("string")
    body = F.concat(action, value, F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit(',"answer":" done  "}}'))
    reply = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("event_id") % 11 == 0, F.lit("no decision"))
        .when(F.col("event_id") % 13 == 0, F.concat(F.lit("{oops} "), body, F.lit(" {tail}")))
        .otherwise(body)
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("tuned").alias("stage"), reply.alias("prediction")
    )


_EXPECT_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPECTED.items())
_SPOKEN_SQL = " ".join(
    f"WHEN {i} THEN '{R.DECISION_ALIASES[s.strip().lower()]}'" for i, s in enumerate(SPOKEN)
)
JUDGED = f"""judged AS (
    SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS stage, event_type AS category,
           CASE event_type {_EXPECT_SQL} END AS expected_action,
           CASE WHEN event_id % 7 <> 0 AND event_id % 11 = 0 THEN 'invalid_json' ELSE CASE user_id % {len(SPOKEN)} {_SPOKEN_SQL} END END AS predicted_action,
           NOT (event_id % 7 <> 0 AND event_id % 11 = 0) AS valid_json, event_id % 3 AS shift FROM events),
    scored AS (
      SELECT *, expected_action = predicted_action AS action_match,
             expected_action = predicted_action AND (expected_action = 'final_answer' OR shift <> 0) AS arguments_match FROM judged)"""


@register("decision_cases", f"WITH {JUDGED} SELECT id, stage, category, expected_action, predicted_action, valid_json, action_match, arguments_match FROM scored")
def decision_cases(spark, sf):
    return E.judge(decision_records(spark, sf), decision_predictions(spark, sf))


_TOOLS = "(" + ", ".join(f"'{t}'" for t in R.TOOL_ACTIONS) + ")"


@register(
    "decision_metrics",
    f"""WITH {JUDGED}, c AS (
      SELECT stage, count(*) AS total, avg(valid_json::INT) AS v, avg(action_match::INT) AS a, avg(arguments_match::INT) AS g,
        count(*) FILTER (WHERE expected_action IN {_TOOLS}) AS wants, count(*) FILTER (WHERE expected_action NOT IN {_TOOLS}) AS finals,
        count(*) FILTER (WHERE predicted_action IN {_TOOLS}) AS uses,
        count(*) FILTER (WHERE expected_action IN {_TOOLS} AND predicted_action IN {_TOOLS}) AS both_n,
        count(*) FILTER (WHERE expected_action NOT IN {_TOOLS} AND predicted_action IN {_TOOLS}) AS over_n
      FROM scored GROUP BY stage)
    SELECT stage, total, round(v, 9) AS valid_json_rate, round(a, 9) AS action_accuracy, round(g, 9) AS argument_match_rate,
      round(both_n / uses, 9) AS tool_precision, round(both_n / wants, 9) AS tool_recall,
      round(2.0::DOUBLE * (both_n / uses) * (both_n / wants) / (both_n / uses + both_n / wants), 9) AS tool_needed_f1,
      round(over_n / finals, 9) AS over_tool_rate FROM c""",
)
def decision_metrics(spark, sf):
    m = E.decision_metrics(decision_cases(spark, sf), ["stage"])
    return m.select("stage", "total", *[F.round(c, 9).alias(c) for c in m.columns if c not in ("stage", "total")])


@register("confusion", f"WITH {JUDGED} SELECT expected_action, predicted_action, count(*) AS n FROM judged GROUP BY ALL")
def confusion(spark, sf):
    return E.confusion(decision_cases(spark, sf))


def _report_sql(source: str) -> str:
    """``stage, metric, percent`` of all five reported rates over judged cases."""
    return f"""c AS (SELECT stage, avg(valid_json::INT) AS valid_json_rate, avg(action_match::INT) AS action_accuracy, avg(arguments_match::INT) AS argument_match_rate,
        count(*) FILTER (expected_action IN {_TOOLS}) AS wants, count(*) FILTER (predicted_action IN {_TOOLS}) AS uses,
        count(*) FILTER (expected_action IN {_TOOLS} AND predicted_action IN {_TOOLS}) AS both_n,
        coalesce(count(*) FILTER (expected_action NOT IN {_TOOLS} AND predicted_action IN {_TOOLS}) / nullif(count(*) FILTER (expected_action NOT IN {_TOOLS}), 0), 0) AS over_tool_rate
      FROM {source} GROUP BY stage),
    rates AS (SELECT stage, valid_json_rate, action_accuracy, argument_match_rate, over_tool_rate,
      coalesce(2.0::DOUBLE * (both_n / nullif(uses, 0)) * (both_n / nullif(wants, 0)) / nullif(both_n / nullif(uses, 0) + both_n / nullif(wants, 0), 0), 0) AS tool_needed_f1 FROM c)
    SELECT stage, metric, printf('%.1f%%', value * 100) AS percent FROM (UNPIVOT rates
      ON valid_json_rate, action_accuracy, tool_needed_f1, argument_match_rate, over_tool_rate INTO NAME metric VALUE value)"""


@register("decision_report", f"WITH {JUDGED}, {_report_sql('scored')}")
def decision_report(spark, sf):
    return E.report(E.decision_metrics(decision_cases(spark, sf), ["stage"])).select("stage", "metric", "percent")


@register(
    "evaluate_decisions",
    f"""WITH {JUDGED}, stages AS (
      SELECT 'before' AS stage, expected_action, predicted_action, valid_json, action_match, arguments_match FROM scored
      UNION ALL SELECT 'after', expected_action, CASE WHEN id % 4 = 0 THEN expected_action ELSE predicted_action END,
        valid_json OR id % 4 = 0, action_match OR id % 4 = 0, arguments_match OR id % 4 = 0 FROM scored), {_report_sql('stages')}""",
)
def evaluate_decisions(spark, sf):
    """The whole job: every record judged before and after a quarter of the predictions was put right."""
    records = decision_records(spark, sf)
    given = decision_predictions(spark, sf).drop("stage")
    mended = given.join(records.select("id", "expected"), "id").select(
        "id", F.when(F.col("id") % 4 == 0, F.col("expected")).otherwise(F.col("prediction")).alias("prediction")
    )
    predictions = given.withColumn("stage", F.lit("before")).unionByName(mended.withColumn("stage", F.lit("after")))
    return jobs.evaluate_decisions(records, predictions)["report"].select("stage", "metric", "percent")


@register(
    "decision_gaps",
    """SELECT event_id AS id, CASE event_id % 2 WHEN 0 THEN 'tuned' ELSE 'base' END AS stage, 1 AS n_records, 0 AS n_predictions FROM events
    UNION ALL SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'base' ELSE 'tuned' END, 1, 2 FROM events WHERE event_id % 17 = 0""",
)
def decision_gaps(spark, sf):
    """Every stage judges half the records, and every 17th prediction is delivered twice."""
    given = decision_predictions(spark, sf)
    return E.unmatched(decision_records(spark, sf), given.unionByName(given.where(F.col("id") % 17 == 0)))


@register(
    "planned_routes",
    """WITH d AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'weather' WHEN 'click' THEN ' Search ' WHEN 'signup' THEN 'none'
        WHEN 'purchase' THEN 'teleport' ELSE 'public_web_search' END AS tool, value FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL ELSE CASE trim(lower(tool)) WHEN 'weather' THEN 'weather_lookup' WHEN 'search' THEN 'public_web_search'
        WHEN 'public_web_search' THEN 'public_web_search' END END AS tool_name,
      CASE WHEN event_id % 5 <> 0 AND trim(lower(tool)) IN ('weather', 'search', 'public_web_search') THEN greatest(0.0, least(1.0, value)) END AS confidence,
      CASE WHEN event_id % 5 <> 0 AND tool = 'teleport' THEN 'Unsupported planner tool: teleport' END AS error FROM d""",
)
def planned_routes(spark, sf):
    tools = F.create_map(*[F.lit(x) for kv in {"view": "weather", "click": " Search ", "signup": "none", "purchase": "teleport"}.items() for x in kv])
    d = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "No").otherwise("yes").alias("use_tool"),
        F.coalesce(F.try_element_at(tools, F.col("event_type")), F.lit("public_web_search")).alias("tool_name"),
        F.col("value").cast("string").alias("confidence"),
        F.lit("").alias("reason"),
    )
    return D.planned_route(d).select("event_id", "route.tool_name", "route.confidence", "error")


@register(
    "tool_risk",
    """SELECT event_id, CASE WHEN event_type IN ('error') OR event_id % 2 = 0 THEN 'read_only' WHEN event_type = 'purchase' THEN 'side_effect_allowed' ELSE 'side_effect' END AS risk,
      NOT (event_type = 'error' OR event_id % 2 = 0 OR event_type = 'purchase') AS blocked FROM events""",
)
def tool_risk(spark, sf):
    """Recorded calls; names that start like a read are safe, an allow-list clears others."""
    calls = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "read_log").otherwise(F.concat(F.lit("do_"), "event_type")).alias("name"),
        (F.col("event_id") % 2 == 0).alias("read_only_hint"),
    )
    allowed = calls.where(F.col("name") == "do_purchase").select("name").distinct()
    return D.tool_risk(calls, allowed).select("event_id", "risk", "blocked")


# --- answer quality ---------------------------------------------------------------------


def quality_inputs(spark: SparkSession, sf: str):
    """Runs from all assistant turns and, as further runs, empty, restrictive and short answers; the rest is derived from the turn."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    run_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    n = F.length("text")
    whole = turns.select(run_id.alias("run_id"), F.col("text").alias("answer"), n.alias("n"))
    other = F.when(F.col("n") % 10 == 0, "").when(F.col("n") % 10 == 1, "当前知识库没有答案").otherwise("short one")
    base = whole.unionByName(whole.where(F.col("n") % 10 <= 2).select(F.concat("run_id", F.lit("-x")).alias("run_id"), other.alias("answer"), "n"))
    runs = base.select(
        "run_id",
        "answer",
        F.when(F.col("n") % 4 != 0, "done").alias("solver_summary"),
        (F.col("n") % 3).cast("int").alias("replan_count"),
    )
    steps = F.explode(F.sequence(F.lit(1), (F.col("n") % 5).cast("int") + 1)).alias("step_no")
    trace = base.where(F.col("n") % 6 != 0).select("run_id", "n", steps).select(
        "run_id",
        F.when(F.col("step_no") == 5, "fallback-5").otherwise(F.concat(F.lit("step-"), "step_no")).alias("step_id"),
        F.lit("Retrieve").alias("title"),
        F.when((F.col("n") % 7 == 0) & (F.col("step_no") == 1), "error").otherwise("completed").alias("status"),
        F.lit("ok").alias("summary"),
    )
    items = F.explode(F.sequence(F.lit(1), (F.col("n") % 4).cast("int"))).alias("k")
    evidence = base.where(F.col("n") % 4 > 0).select("run_id", "n", items).select(
        "run_id", F.concat(F.lit("C"), "k").alias("label"), ((F.col("n") % 50) / 100.0).alias("score")
    )
    cites = F.explode(F.sequence(F.lit(1), (F.col("n") % 3).cast("int"))).alias("k")
    citations = base.where(F.col("n") % 3 > 0).select("run_id", cites).select("run_id", F.concat(F.lit("C"), "k").alias("label"))
    memory = base.where(F.col("n") % 2 == 0).select("run_id", F.lit(2).alias("n_updates"))
    return runs, trace, evidence, citations, memory


_N = "length(text)"


@register(
    "quality_score",
    f"""WITH w AS (SELECT conv_id || '-' || turn AS run_id, text, length(text) AS n FROM conversations WHERE role = 'assistant'),
    b AS (SELECT * FROM w UNION ALL
      SELECT run_id || '-x', CASE n % 10 WHEN 0 THEN '' WHEN 1 THEN '当前知识库没有答案' ELSE 'short one' END, n FROM w WHERE n % 10 <= 2),
    f AS (
      SELECT run_id, n, {S.strip("text")} AS answer,
             n % 4 <> 0 AS summarised, CASE WHEN n % 6 <> 0 THEN n % 5 + 1 ELSE 0 END AS steps,
             n % 6 <> 0 AND n % 7 = 0 AS failed, n % 6 <> 0 AND n % 5 = 4 AS fell_back,
             n % 4 AS ev, (n % 50) / 100.0::DOUBLE AS top, n % 3 AS ci FROM b),
    g AS (SELECT *, contains(answer, '当前知识库') AS restrictive FROM f),
    s AS (SELECT *, round(greatest(0.0::DOUBLE, least(5.0::DOUBLE,
        (CASE WHEN answer <> '' THEN 1.0 ELSE 0 END) + (CASE WHEN steps > 0 THEN 0.8 ELSE 0 END) + (CASE WHEN summarised THEN 0.4 ELSE 0 END)
        + (CASE WHEN NOT failed THEN 0.5 ELSE 0 END) + (CASE WHEN ev > 0 THEN 1.0 ELSE 0 END)
        + (CASE WHEN ev > 0 AND top >= 0.35 THEN 0.4 WHEN ev > 0 AND top >= 0.18 THEN 0.2 ELSE 0 END)
        + (CASE WHEN ci > 0 THEN 1.0 ELSE 0 END) + (CASE WHEN ci > 0 AND ci <= ev THEN 0.3 ELSE 0 END)
        + (CASE WHEN ev > 0 AND ci > 0 AND answer <> '' THEN 0.5 ELSE 0 END) - (CASE WHEN restrictive THEN 1.0 ELSE 0 END)
        - (CASE WHEN answer <> '' AND length(answer) < 20 THEN 0.3 ELSE 0 END) + (CASE WHEN n % 2 = 0 THEN 0.2 ELSE 0 END)::DOUBLE)), 2) AS score FROM g)
    SELECT run_id, score, CASE WHEN score >= 4.25 THEN 'high' WHEN score >= 3.25 THEN 'medium' WHEN score >= 2.0 THEN 'low' ELSE 'failing' END AS level,
      ev > 0 AND ci > 0 AND answer <> '' AND NOT restrictive AND NOT fell_back AS grounded, restrictive OR fell_back AS fallback_used,
      array_to_string(list_filter([
        CASE WHEN answer = '' THEN 'empty_answer' END, CASE WHEN steps = 0 THEN 'missing_execution_trace' END,
        CASE WHEN NOT summarised THEN 'missing_solver_summary' END, CASE WHEN failed THEN 'failed_steps:1' END,
        CASE WHEN ev > 0 AND top < 0.18 THEN 'weak_top_evidence' END, CASE WHEN ev = 0 THEN 'no_retrieved_evidence' END,
        CASE WHEN ci > 0 AND ci > ev THEN 'citation_label_not_in_evidence' END, CASE WHEN ci = 0 AND ev > 0 THEN 'retrieved_evidence_not_cited' END,
        CASE WHEN ci = 0 AND ev = 0 THEN 'uncited_answer' END, CASE WHEN restrictive THEN 'restrictive_fallback_text' END,
        CASE WHEN fell_back THEN 'fallback_steps:1' END, CASE WHEN answer <> '' AND length(answer) < 20 THEN 'very_short_answer' END],
        lambda x: x IS NOT NULL), ',') AS gaps
    FROM s""",
)
def quality_score(spark, sf):
    return Q.score_answers(*quality_inputs(spark, sf)).select(
        "run_id", "score", "level", "grounded", "fallback_used", F.array_join("gaps", ",").alias("gaps")
    )
