"""Layered memory over the conversations table.

A run is a user turn with the assistant turn right after it; conversations are
sessions, and ten projects hold them. Trailing user turns are open questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import rules as R
from inkwell.functions import text as T
from inkwell.operators import memory as M
from inkwell.operators.segments import running_before
from inkwell.session import materialized, table
from inkwell.workload import sqltext as S
from inkwell.workload.registry import register

PROJECTS = 10
NOW = "2024-06-01 00:00:00"
SMALL = Settings(working_token_threshold=300)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("p"), (F.col("conv_id") % PROJECTS).cast("string")).alias("project_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        "conv_id",
        "turn",
        "role",
        "text",
        F.timestamp_micros(
            F.lit(1704067200000000) + F.col("conv_id") * 60_000_000 + F.col("turn") * 1_000_000
        ).alias("updated_at"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Joined on (session, turn), so even a huge session spreads over all tasks."""
    all_turns = turns(spark, sf)
    asked = all_turns.where(F.col("role") == "user").select(
        "project_id", "session_id", "turn", F.col("text").alias("user_query"), "updated_at"
    )
    answered = all_turns.where(F.col("role") == "assistant").select(
        "session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    paired = asked.join(answered, ["session_id", "turn"])
    numbered = running_before(paired, M.SESSION, "turn", [], F.lit(1), "earlier")
    return numbered.withColumn("sequence_id", F.col("earlier") + 1).drop("earlier")


def open_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Last user turn of every session that has no answer yet."""
    all_turns = turns(spark, sf)
    answered = all_turns.where(F.col("role") == "assistant").select("session_id", (F.col("turn") - 1).alias("turn"))
    return (
        all_turns.where(F.col("role") == "user")
        .join(answered, ["session_id", "turn"], "left_anti")
        .select(F.col("conv_id").alias("query_id"), "project_id", "session_id", F.col("text").alias("query"))
    )


def working(spark, sf):
    base = runs(spark, sf)
    return M.working_rows(base)


RUNS = f"""turns AS (
      SELECT 'p' || (conv_id % {PROJECTS}) AS project_id, 's' || conv_id AS session_id, conv_id, turn, role, text,
             TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) AS updated_at
      FROM conversations),
    runs AS (
      SELECT u.project_id, u.session_id, u.turn, u.text AS user_query, a.text AS answer, u.updated_at,
             row_number() OVER (PARTITION BY u.session_id ORDER BY u.turn) AS sequence_id
      FROM turns u JOIN turns a ON a.session_id = u.session_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'),
    asked AS (
      SELECT u.conv_id AS query_id, u.project_id, u.session_id, u.text AS query
      FROM turns u WHERE u.role = 'user' AND NOT EXISTS (
        SELECT 1 FROM turns a WHERE a.session_id = u.session_id AND a.turn = u.turn + 1 AND a.role = 'assistant'))"""

WM_ID = "'wm-' || md5(session_id || chr(31) || sequence_id || chr(31) || memory_key)"
WORKING = f"""{RUNS},
    items AS (
      SELECT project_id, session_id, sequence_id, 0 AS ordinal, 'turn_' || sequence_id || '_query' AS memory_key,
             {S.compact('user_query', 240)} AS content, 0.7 AS importance, 'query' AS kind, updated_at FROM runs
      UNION ALL
      SELECT project_id, session_id, sequence_id, 1, 'turn_' || sequence_id || '_answer',
             {S.compact('answer', 240)}, 0.8, 'answer_summary', updated_at FROM runs),
    working AS (
      SELECT {WM_ID} AS id, *, greatest(1, {S.token_count("memory_key || ': ' || content")}) AS tokens FROM items)"""


@register(
    "working_memory_rows",
    f"""WITH {WORKING} SELECT id, project_id, session_id, sequence_id, memory_key, content,
    importance::DOUBLE AS importance, kind FROM working""",
)
def working_memory_rows(spark, sf):
    return working(spark, sf).select(
        "id", "project_id", "session_id", "sequence_id", "memory_key", "content", "importance", "kind"
    )


@register(
    "token_totals",
    f"""WITH {WORKING} SELECT project_id, session_id, sum(tokens)::BIGINT AS total_tokens, count(*) AS n_items
    FROM working GROUP BY project_id, session_id""",
)
def token_totals(spark, sf):
    return M.session_token_totals(working(spark, sf))


COMPACT = f"""over AS (SELECT session_id, sum(tokens)::BIGINT AS total_tokens FROM working GROUP BY session_id HAVING sum(tokens) > 300),
    ordered AS (
      SELECT w.*, total_tokens, coalesce(sum(tokens) OVER (PARTITION BY w.session_id ORDER BY sequence_id, ordinal
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before
      FROM working w JOIN over USING (session_id)),
    picked AS (SELECT * FROM ordered WHERE tokens_before < 225)"""


@register(
    "compaction_pick",
    f"""WITH {WORKING}, {COMPACT}
    SELECT session_id, memory_key, tokens, tokens_before, total_tokens FROM picked""",
)
def compaction_pick(spark, sf):
    picked = M.compaction_pick(working(spark, sf), SMALL)
    return picked.select(
        "session_id", "memory_key", F.col("tokens").cast("bigint").alias("tokens"), "tokens_before", "total_tokens"
    )


@register(
    "compaction_batches",
    f"""WITH {WORKING}, {COMPACT}
    SELECT project_id, session_id, max(sequence_id) AS last_sequence_id, sum(tokens)::BIGINT AS compacted_tokens,
           max(total_tokens) AS total_tokens, count(*) AS n_items,
           string_agg(id, ',' ORDER BY sequence_id, ordinal) AS item_ids
    FROM picked GROUP BY project_id, session_id""",
)
def compaction_batches(spark, sf):
    batches = M.compaction_batches(M.compaction_pick(working(spark, sf), SMALL), SMALL)
    return batches.select(
        "project_id", "session_id", "last_sequence_id", "compacted_tokens", "total_tokens",
        F.col("n_items").cast("bigint").alias("n_items"), F.array_join("item_ids", ",").alias("item_ids"),
    )


def _picked_context(threshold: int) -> str:
    return f"""context_totals AS (SELECT session_id, sum(tokens) AS total FROM working GROUP BY session_id),
    queue AS (
      SELECT w.*, total, row_number() OVER (PARTITION BY w.session_id ORDER BY sequence_id DESC, ordinal DESC) AS n
      FROM working w JOIN context_totals USING (session_id)),
    fold AS (
      SELECT session_id, n, tokens AS used, true AS taken FROM queue WHERE n = 1
      UNION ALL
      SELECT q.session_id, q.n,
             CASE WHEN f.used >= {threshold} OR f.used + q.tokens > {threshold} THEN f.used ELSE f.used + q.tokens END,
             NOT (f.used >= {threshold} OR f.used + q.tokens > {threshold})
      FROM fold f JOIN queue q ON q.session_id = f.session_id AND q.n = f.n + 1),
    context AS (SELECT q.* FROM queue q JOIN fold f USING (session_id, n) WHERE total <= {threshold} OR taken)"""


@register("context_pick", f"WITH RECURSIVE {WORKING}, {_picked_context(300)} SELECT session_id, memory_key, tokens FROM context")
def context_pick(spark, sf):
    picked = M.context_pick(working(spark, sf), SMALL)
    return picked.select("session_id", "memory_key", F.col("tokens").cast("bigint").alias("tokens"))


@register(
    "recent_turns",
    f"""WITH {RUNS}, last AS (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_id DESC) AS n FROM runs)
    SELECT project_id, session_id, string_agg('- 用户#' || sequence_id || ': ' || {S.compact_named('user_query', 120)} || chr(10) ||
      '  助手#' || sequence_id || ': ' || {S.compact_named('answer', 160)}, chr(10) ORDER BY sequence_id) AS session_context
    FROM last WHERE n <= 4 GROUP BY project_id, session_id""",
)
def recent_turns(spark, sf):
    return M.recent_turns(runs(spark, sf))


EPISODES = f"""{RUNS}, episodes AS (
      SELECT 'ep-' || md5(session_id || chr(31) || sequence_id) AS id, project_id, session_id, sequence_id,
             'research_run' AS event_type, {S.compact("user_query || ' -> ' || answer", 220)} AS summary,
             user_query, {S.compact('answer', 240)} AS answer_summary, 0.75 AS importance, updated_at FROM runs)"""


def episodes(spark, sf):
    return M.episodic_rows(runs(spark, sf))


@register(
    "episodic_rows",
    f"""WITH {EPISODES} SELECT id, project_id, session_id, sequence_id, event_type, summary, importance::DOUBLE AS importance,
    user_query AS query, answer_summary FROM episodes""",
)
def episodic_rows(spark, sf):
    details = F.from_json("details", "query string, answer_summary string")
    return M.episodic_rows(runs(spark, sf)).select(
        "id", "project_id", "session_id", "sequence_id", "event_type", "summary", "importance",
        details["query"].alias("query"), details["answer_summary"].alias("answer_summary"),
    )


EVENT_TEXT = "summary || ' ' || user_query || ' ' || answer_summary || ' sequence_id query todo_title answer_summary citations ' || sequence_id"


def _recalled_episodes(event: str = EVENT_TEXT) -> str:
    return f"""recent_episodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) AS recency
      FROM episodes) WHERE recency <= 16),
    scored_episodes AS (
      SELECT query_id, r.id, recency, event_type, summary, round(
        len(list_intersect({S.tokens('query')}, {S.tokens(event)}))
        + 0.6::DOUBLE * (1.0::DOUBLE / (1.0 + (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 3.6e9::DOUBLE / 24.0::DOUBLE))
        + importance::DOUBLE, 6) AS score
      FROM asked a JOIN recent_episodes r USING (project_id)),
    recalled_episodes AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recency) AS rank FROM scored_episodes) WHERE rank <= 4)"""


@register(
    "episodic_recall",
    f"""WITH {EPISODES}, {_recalled_episodes()} SELECT query_id, id, score, rank FROM recalled_episodes""",
)
def episodic_recall(spark, sf):
    """Event text here is summary, query, answer and the detail keys, as in the stored details."""
    rows = episodes(spark, sf)
    d = F.from_json("details", "query string, answer_summary string")
    flat = rows.withColumn(
        "details",
        F.concat_ws(
            " ", d["query"], d["answer_summary"],
            F.lit("sequence_id query todo_title answer_summary citations"), F.col("sequence_id").cast("string"),
        ),
    )
    hits = M.episodic_recall(open_questions(spark, sf), flat, F.lit(NOW).cast("timestamp"))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


FIRST = f"list_extract({S.short_sentences('answer')}, 1)"
DRAFTS = f"""{RUNS},
    base AS (SELECT *, {FIRST} AS first FROM runs),
    raw_drafts AS (
      SELECT session_id, project_id, sequence_id, updated_at, 0 AS position, 'fact' AS fact_type,
             'answer_' || {S.key_slug('coalesce(first, user_query)')} AS memory_key,
             {S.compact('coalesce(first, answer)', 220)} AS statement, {S.compact('coalesce(first, answer)', 120)} AS object, 0.72 AS importance FROM base
      UNION ALL
      SELECT session_id, project_id, sequence_id, updated_at, 1, 'open_question', 'question_' || {S.key_slug('user_query')},
             {S.compact('user_query', 220)}, {S.compact('user_query', 120)}, 0.66 FROM base
      UNION ALL
      SELECT session_id, project_id, sequence_id, updated_at, 2, 'decision', 'decision_' || {S.key_slug('first')},
             {S.compact('first', 220)}, {S.compact('first', 120)}, 0.78 FROM base WHERE first IS NOT NULL)"""


@register(
    "fact_drafts",
    f"""WITH {DRAFTS} SELECT session_id, sequence_id, fact_type, memory_key, statement, object, importance::DOUBLE AS importance
    FROM raw_drafts""",
)
def fact_drafts(spark, sf):
    return M.fact_drafts(runs(spark, sf)).select(
        "session_id", "sequence_id", "fact_type", "memory_key", "statement", "object", "importance"
    )


FACTS = f"""{DRAFTS}, facts AS (
      SELECT 'sm-' || md5(project_id || chr(31) || fact_type || chr(31) || memory_key) AS id,
             project_id, fact_type, memory_key,
             arg_max(session_id, (updated_at, session_id, sequence_id, position)) AS session_id,
             arg_max(sequence_id, (updated_at, session_id, sequence_id, position)) AS sequence_id,
             arg_max(statement, (updated_at, session_id, sequence_id, position)) AS statement,
             arg_max(importance, (updated_at, session_id, sequence_id, position))::DOUBLE AS importance,
             max(updated_at) AS updated_at
      FROM raw_drafts GROUP BY project_id, fact_type, memory_key)"""


def facts(spark, sf):
    return M.upsert_facts(M.fact_drafts(runs(spark, sf)))


@register(
    "fact_upsert",
    f"""WITH {FACTS} SELECT id, project_id, fact_type, memory_key, session_id, sequence_id, statement, importance FROM facts""",
)
def fact_upsert(spark, sf):
    return facts(spark, sf).select(
        "id", "project_id", "fact_type", "memory_key", "session_id", "sequence_id", "statement", "importance"
    )


@register(
    "memory_union",
    f"""WITH {FACTS}, items AS (
      SELECT project_id, session_id, sequence_id, 'turn_' || sequence_id || '_query' AS memory_key,
             {S.compact('user_query', 240)} AS memory_value, updated_at FROM runs
      UNION ALL
      SELECT project_id, session_id, sequence_id, 'turn_' || sequence_id || '_answer', {S.compact('answer', 240)}, updated_at FROM runs)
    SELECT {WM_ID} AS id, project_id, 'working' AS memory_type, memory_key, memory_value, updated_at FROM items
    UNION ALL
    SELECT 'ep-' || md5(session_id || chr(31) || sequence_id), project_id, 'episodic', 'research_run',
           {S.compact("user_query || ' -> ' || answer", 220)}, updated_at FROM runs
    UNION ALL
    SELECT id, project_id, 'semantic.' || fact_type, memory_key, statement, updated_at FROM facts""",
)
def memory_union(spark, sf):
    base = materialized(runs(spark, sf), "runs")
    facts_now = M.upsert_facts(M.fact_drafts(base))
    return M.layered_memories(M.working_rows(base), M.episodic_rows(base), facts_now).select(
        "id", "project_id", "memory_type", "memory_key", "memory_value", "updated_at"
    )


RECALLED_FACTS = f"""recent_facts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) AS recency
      FROM facts) WHERE recency <= 36),
    fact_corpus AS (SELECT project_id AS scope_id, id AS chunk_id, recency AS pos, importance, {S.fallback_tokens('statement')} AS tokens FROM recent_facts),
    fact_terms AS (SELECT query_id, project_id AS scope_id, unnest({S.fallback_tokens('query')}) AS token FROM asked),
    fact_totals AS (SELECT scope_id, count(*) AS n, avg(len(tokens)) AS avg_len FROM fact_corpus GROUP BY scope_id),
    fact_postings AS (SELECT scope_id, chunk_id, pos, importance, len(tokens) AS doc_len, unnest(tokens) AS token FROM fact_corpus),
    raw_idf AS (SELECT scope_id, token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r
      FROM fact_postings JOIN fact_totals USING (scope_id) GROUP BY scope_id, token),
    means AS (SELECT scope_id, avg(r) AS m FROM raw_idf GROUP BY scope_id),
    idf AS (SELECT scope_id, token, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw_idf JOIN means USING (scope_id)),
    fact_pairs AS (
      SELECT query_id, chunk_id, pos, importance, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS bm25
      FROM fact_terms JOIN idf USING (scope_id, token) JOIN fact_postings USING (scope_id, token) JOIN fact_totals USING (scope_id)
      GROUP BY query_id, chunk_id, pos, importance),
    fact_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, pos) AS n FROM fact_pairs WHERE bm25 > 0) WHERE n <= 24),
    scored_facts AS (SELECT *, round(2.0::DOUBLE / (60 + n), 9) AS fusion, round(round(1.0::DOUBLE / (60 + n) * 2, 9) + 2 * bm25, 9) AS score FROM fact_hits),
    ranked_facts AS (SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, importance DESC, n) AS rank, score FROM scored_facts),
    recalled_facts AS (SELECT query_id, id, rank, round(score, 6) AS score FROM ranked_facts WHERE rank <= 6
    UNION ALL
    SELECT query_id, r.id, recency, NULL FROM asked a JOIN recent_facts r USING (project_id)
    WHERE recency <= 6 AND query_id NOT IN (SELECT query_id FROM ranked_facts))"""


@register("semantic_recall", f"WITH {FACTS}, {RECALLED_FACTS} SELECT query_id, id, rank, score FROM recalled_facts")
def semantic_recall(spark, sf):
    hits = M.semantic_recall(open_questions(spark, sf), materialized(facts(spark, sf), "facts"))
    return hits.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def summarised_batches(spark, sf):
    """Batches with a model reply derived from their own rows: fenced JSON, odd type, importance out of range."""
    batches = M.compaction_batches(M.compaction_pick(working(spark, sf), SMALL), SMALL)
    first = F.get_json_object("working_memories", "$[0].content")
    reply = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("").alias("event_type"), first.alias("summary"), F.lit("1.4").alias("importance")),
                F.struct(F.lit("note").alias("event_type"), F.lit("").alias("summary"), F.lit("x").alias("importance")),
            ).alias("episodic_memories"),
            F.array(
                F.struct(F.lit("rumour").alias("fact_type"), first.alias("statement"), F.lit("oops").alias("importance"))
            ).alias("semantic_memories"),
        )
    )
    return batches.withColumn("summary_json", F.concat(F.lit("```json\n"), reply, F.lit("\n```")))


@register(
    "compaction_summaries",
    f"""WITH {WORKING}, {COMPACT},
    batch AS (SELECT project_id, session_id, max(sequence_id) AS sequence_id,
      arg_min(content, (sequence_id, ordinal)) AS first FROM picked GROUP BY project_id, session_id)
    SELECT session_id, sequence_id, 'episodic' AS layer, 'working_memory_summary' AS kind, {S.compact('first', 900)} AS value,
           1.0::DOUBLE AS importance FROM batch WHERE {S.compact('first', 900)} <> ''
    UNION ALL
    SELECT session_id, sequence_id, 'semantic', substring('fact_' || {S.key_slug(S.compact('first', 900))}, 1, 64),
           {S.compact('first', 900)}, 0.72::DOUBLE FROM batch WHERE {S.compact('first', 900)} <> ''""",
)
def compaction_summaries(spark, sf):
    batches = summarised_batches(spark, sf)
    e = M.summary_episodes(batches).select(
        "session_id", "sequence_id", F.lit("episodic").alias("layer"), F.col("event_type").alias("kind"),
        F.col("summary").alias("value"), "importance",
    )
    f = M.summary_facts(batches).select(
        "session_id", "sequence_id", F.lit("semantic").alias("layer"), F.col("memory_key").alias("kind"),
        F.col("statement").alias("value"), "importance",
    )
    return e.unionByName(f)


@register(
    "working_after_compaction",
    f"""WITH {WORKING}, {COMPACT} SELECT w.session_id, w.memory_key FROM working w
    WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.id = w.id AND p.session_id = w.session_id)""",
)
def working_after_compaction(spark, sf):
    rows = materialized(working(spark, sf), "working")
    picked = M.compaction_pick(rows, SMALL)
    batches = summarised_batches(spark, sf)
    kept = M.drop_compacted(rows, picked, M.summary_episodes(batches), M.summary_facts(batches))
    return kept.select("session_id", "memory_key")


#: Event text as stored: JSON with escaped line breaks.
STORED_EVENT = """summary || ' {"sequence_id":' || sequence_id || ',"query":"' || replace(user_query, chr(10), chr(92) || 'n') || '","todo_title":"","answer_summary":"' || answer_summary || '","citations":[]}'"""
LAYERS = f"{FACTS}{EPISODES[len(RUNS):]}{WORKING[len(RUNS):]}, {_picked_context(DEFAULTS.working_token_threshold)}, {_recalled_episodes(STORED_EVENT)}, {RECALLED_FACTS}"
WORKING_LINE = f"'- ' || memory_key || ': ' || {S.compact('content', 240)}"
EPISODE_LINE = f"'- [' || event_type || '] ' || {S.compact('summary', 160)}"


@register(
    "focused_memory",
    f"""WITH RECURSIVE {LAYERS}, lines AS (
      SELECT query_id, query, 0 AS layer, sequence_id * 2 + ordinal AS line_no, {WORKING_LINE} AS line FROM asked JOIN context USING (session_id)
      UNION ALL SELECT query_id, query, 1, rank, {EPISODE_LINE} FROM recalled_episodes JOIN asked USING (query_id)),
    raw_terms AS (SELECT DISTINCT query_id, query, list_filter(list_concat(regexp_extract_all(lower(query), {S.quoted(T.LATIN_TOKEN)}),
        ['定义', '原理', '应用'], regexp_extract_all(lower({S.compact_named('query', 80)} || '{R.CONCEPT_SUFFIX}'), {S.quoted(T.LATIN_TOKEN)}),
        list_transform(regexp_extract_all(query, '[一-鿿]{{2,}}|[A-Za-z0-9_./+-]{{2,}}'), lambda x: lower(x))), lambda v: length(v) >= 2) AS raw FROM lines),
    line_terms AS (SELECT query_id, query, list_slice(list_filter(raw, lambda v, i: list_position(raw, v) = i), 1, 24) AS terms FROM raw_terms),
    line_scores AS (SELECT l.*, len(list_filter(terms, lambda v: contains(lower(line), v))) AS score FROM lines l JOIN line_terms USING (query_id)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, layer, line_no) AS rank
      FROM line_scores WHERE score > 0) WHERE rank <= 6),
    blocks AS (SELECT query_id, layer, CASE layer WHEN 0 THEN '### Relevant Working Memory' ELSE '### Relevant Episodic Memory' END || chr(10) ||
      string_agg(line, chr(10) ORDER BY rank) AS block, count(*) AS n FROM best GROUP BY query_id, layer),
    found AS (SELECT query_id, string_agg(block, chr(10) ORDER BY layer) AS text, sum(n)::INTEGER AS n_lines FROM blocks GROUP BY query_id)
    SELECT query_id, coalesce(text, '没有找到与“' || {S.compact_named('query', 80)} || '”直接相关的项目记忆。') AS text, coalesce(n_lines, 0) AS n_lines
    FROM line_terms LEFT JOIN found USING (query_id)""",
)
def focused_memory(spark, sf):
    """The memory lines of a session that speak to its open question, best six, grouped by layer."""
    asked = open_questions(spark, sf)
    w = asked.join(M.context_pick(working(spark, sf)), M.SESSION).select(
        "query_id", "query", F.lit(0).alias("layer"),
        (F.col("sequence_id") * 2 + F.col("ordinal")).alias("line_no"), M.working_line().alias("line"),
    )
    e = M.episodic_recall(asked, episodes(spark, sf), F.lit(NOW).cast("timestamp")).select(
        "query_id", "query", F.lit(1).alias("layer"), F.col("rank").cast("bigint").alias("line_no"), M.episodic_line().alias("line")
    )
    return M.focused_lines(w.unionByName(e))


def _excerpt(x: str, empty: str, limit: int) -> str:
    text = S.strip(f"coalesce({x}, '')")
    return f"(CASE WHEN {text} = '' THEN '{empty}' ELSE {S.strip(f'substring({text}, 1, {limit})')} END)"


@register(
    "memory_context",
    f"""WITH RECURSIVE {LAYERS},
    last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_id DESC) AS n FROM runs),
    shown AS (SELECT session_id, string_agg('- 用户#' || sequence_id || ': ' || {S.compact_named('user_query', 120)} || chr(10) ||
      '  助手#' || sequence_id || ': ' || {S.compact_named('answer', 160)}, chr(10) ORDER BY sequence_id) AS turns_text FROM last WHERE n <= 4 GROUP BY session_id),
    w AS (SELECT query_id, string_agg({WORKING_LINE}, chr(10) ORDER BY sequence_id, ordinal) AS working_text FROM asked JOIN context USING (session_id) GROUP BY query_id),
    e AS (SELECT query_id, string_agg({EPISODE_LINE}, chr(10) ORDER BY rank) AS episodes_text FROM recalled_episodes GROUP BY query_id),
    f AS (SELECT query_id, string_agg('- ' || fact_type || '.' || memory_key || ': ' || {S.compact('statement', 160)}, chr(10) ORDER BY rank) AS facts_text
      FROM recalled_facts JOIN facts USING (id) GROUP BY query_id)
    SELECT query_id, {_excerpt('turns_text', '- no prior turns yet', 900)} AS session_context,
      'Working Memory' || chr(10) || chr(10) || coalesce(working_text, '- no working memory yet') || chr(10) || chr(10) || 'Episodic Memory' || chr(10) || chr(10) ||
      {_excerpt('episodes_text', '- no episodic memory yet', 1200)} || chr(10) || chr(10) || 'Semantic Memory' || chr(10) || chr(10) ||
      {_excerpt('facts_text', '- no semantic memory yet', 1200)} AS memory_context
    FROM asked LEFT JOIN shown USING (session_id) LEFT JOIN w USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN f USING (query_id)""",
)
def memory_context(spark, sf):
    base = materialized(runs(spark, sf), "runs")
    facts_now = materialized(M.upsert_facts(M.fact_drafts(base)), "facts")
    return M.memory_context(
        open_questions(spark, sf), M.working_rows(base), M.episodic_rows(base), facts_now, base,
        F.lit(NOW).cast("timestamp"),
    ).select("query_id", "session_context", "memory_context")
