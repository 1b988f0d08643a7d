"""Layered memory: rows from turns, token budgets, recall, upserts, compaction and context text.

Tables
------
runs      ``project_id, session_id, sequence_id, user_query, answer`` (+ ``citations``, ``todo_title``)
working   ``id, project_id, session_id, sequence_id, ordinal, memory_key, content, importance, source, kind, created_at``
episodic  ``id, project_id, session_id, sequence_id, event_type, summary, details, importance, updated_at``
facts     ``id, project_id, session_id, sequence_id, fact_type, memory_key, statement, subject, predicate, object,
          importance, metadata, updated_at``

Ids are hashes of the natural key, so reruns give the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import rewrite as W
from inkwell.functions import rules as R
from inkwell.functions import text as T
from inkwell.operators import retrieval as search
from inkwell.operators.segments import newest, running_before, segment_of
from inkwell.session import materialized

SESSION = ["project_id", "session_id"]
SCORE_DIGITS = 9


def stable_id(prefix: str, *parts: Column) -> Column:
    key = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.md5(key))


def _with_defaults(runs: DataFrame) -> DataFrame:
    if "citations" not in runs.columns:
        runs = runs.withColumn("citations", T.no_strings())
    if "todo_title" not in runs.columns:
        runs = runs.withColumn("todo_title", F.lit(""))
    return runs.withColumn("todo_title", F.coalesce("todo_title", F.lit("")))


def _carried(runs: DataFrame) -> list[str]:
    return ["updated_at"] if "updated_at" in runs.columns else []


# --- rows from turns ---------------------------------------------------------------


def working_rows(runs: DataFrame) -> DataFrame:
    """A query row and an answer row per turn."""
    runs = _with_defaults(runs)

    def item(ordinal: int, part: str, kind: str, text: Column, importance: float) -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.concat(F.lit("turn_"), F.col("sequence_id"), F.lit(f"_{part}")).alias("memory_key"),
            T.compact(text, 240).alias("content"),
            F.lit(importance).alias("importance"),
            F.lit(kind).alias("kind"),
        )

    items = F.array(
        item(0, "query", "query", F.col("user_query"), 0.7),
        item(1, "answer", "answer_summary", F.col("answer"), 0.8),
    )
    extra = _carried(runs)
    return runs.select(*SESSION, "sequence_id", "citations", *extra, F.explode(items).alias("m")).select(
        stable_id("wm", F.col("session_id"), F.col("sequence_id"), F.col("m.memory_key")).alias("id"),
        *extra,
        *SESSION,
        "sequence_id",
        "m.*",
        F.lit("runtime_api").alias("source"),
        F.when(F.col("m.kind") == "query", T.no_strings()).otherwise(F.col("citations")).alias("citations"),
    )


def note_rows(notes: DataFrame) -> DataFrame:
    """Explicit memory writes ``…, key, content, importance, user_query`` as working rows."""
    return notes.select(
        stable_id("wm", F.col("session_id"), F.col("sequence_id"), F.col("key"), F.col("content")).alias("id"),
        *SESSION,
        "sequence_id",
        F.lit(2).alias("ordinal"),
        T.compact_named(F.coalesce(F.nullif(F.col("key"), F.lit("")), F.lit("agent_note")), 64).alias("memory_key"),
        T.compact_named(F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("user_query")), 500).alias("content"),
        coerce_importance(F.col("importance"), 0.6).alias("importance"),
        F.lit("agent_memory_write").alias("kind"),
        F.lit("agent_tool").alias("source"),
        T.no_strings().alias("citations"),
    )


def episodic_rows(runs: DataFrame) -> DataFrame:
    runs = _with_defaults(runs)
    topic = F.when(F.col("todo_title") != "", F.col("todo_title")).otherwise(F.col("user_query"))
    return runs.select(
        stable_id("ep", F.col("session_id"), F.col("sequence_id")).alias("id"),
        *_carried(runs),
        *SESSION,
        "sequence_id",
        F.lit("research_run").alias("event_type"),
        T.compact(F.concat(topic, F.lit(" -> "), F.col("answer")), 220).alias("summary"),
        F.to_json(
            F.struct(
                "sequence_id",
                F.col("user_query").alias("query"),
                "todo_title",
                T.compact(F.col("answer"), 240).alias("answer_summary"),
                "citations",
            )
        ).alias("details"),
        F.lit(0.75).alias("importance"),
    )


def fact_drafts(runs: DataFrame) -> DataFrame:
    """Candidate facts per turn; the last draft of a (type, key) wins but keeps its first place."""
    runs = _with_defaults(runs).withColumn("_first", F.try_element_at(T.short_sentences(F.col("answer")), F.lit(1)))
    query, first, todo = F.col("user_query"), F.col("_first"), F.col("todo_title")
    statement = F.coalesce(first, F.col("answer"))
    cited = F.to_json(F.struct("citations"))

    def draft(kind, key, text, subject, predicate, obj, importance, metadata):
        return F.struct(
            F.lit(kind).alias("fact_type"),
            key.alias("memory_key"),
            T.compact(text, 220).alias("statement"),
            F.lit(subject).alias("subject"),
            F.lit(predicate).alias("predicate"),
            obj.alias("object"),
            F.lit(importance).alias("importance"),
            metadata.alias("metadata"),
        )

    def prefixed(prefix, text):
        return F.concat(F.lit(prefix), T.key_slug(text))

    drafts = F.array(
        draft("fact", prefixed("answer_", F.coalesce(first, query)), statement, "project", "latest_fact",
              T.compact(statement, 120), 0.72, cited),
        draft("open_question", prefixed("question_", query), query, "project", "active_question",
              T.compact(query, 120), 0.66, F.to_json(F.struct("todo_title"))),
        F.when(
            todo != "",
            draft("progress", prefixed("todo_", todo), F.concat(F.lit("Completed or advanced TODO: "), todo), "project",
                  "progress", T.compact(todo, 120), 0.7, F.to_json(F.struct(T.compact(query, 160).alias("query")))),
        ),
        F.when(
            first.isNotNull(),
            draft("decision", prefixed("decision_", first), first, "project", "decision", T.compact(first, 120), 0.78, cited),
        ),
    )
    hints = F.transform(
        W.preference_hints(query),
        lambda h: draft("preference", prefixed("preference_", h), query, "user", "preference", h, 0.74,
                        F.to_json(F.struct(h.alias("hint")))),
    )
    turn = [*SESSION, "sequence_id", *_carried(runs)]
    rows = runs.select(*turn, F.posexplode_outer(F.array_compact(F.concat(drafts, hints))).alias("at", "d"))
    # Drafts of one turn are at most a handful, so this group is bounded.
    return (
        rows.groupBy(*turn, F.col("d.fact_type").alias("fact_type"), F.col("d.memory_key").alias("memory_key"))
        .agg(F.min("at").alias("position"), F.max_by("d", "at").alias("d"))
        .select(*turn, "position", "d.*")
    )


# --- token budgets -----------------------------------------------------------------


def with_tokens(working: DataFrame) -> DataFrame:
    line = F.concat(F.col("memory_key"), F.lit(": "), F.col("content"))
    return working.withColumn("tokens", F.greatest(F.lit(1), T.token_count(line)))


def session_token_totals(working: DataFrame) -> DataFrame:
    return with_tokens(working).groupBy(*SESSION).agg(F.sum("tokens").alias("total_tokens"), F.count("*").alias("n_items"))


def compaction_pick(working: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Oldest rows of every session over its threshold, up to the target share.

    A row is taken while the rows before it stay below the target.
    """
    threshold = max(1, settings.working_token_threshold)
    target = max(1, math.ceil(threshold * settings.compaction_share))
    items = with_tokens(working)
    over = items.groupBy(*SESSION).agg(F.sum("tokens").alias("total_tokens")).where(F.col("total_tokens") > threshold)
    ordered = running_before(
        items.join(over, SESSION), SESSION, "sequence_id", ["ordinal"], F.col("tokens"), "tokens_before"
    )
    return ordered.where(F.col("tokens_before") < target)


def compaction_batches(picked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One batch per session: payload and provenance. Picked rows are bounded by the token target."""
    items = F.array_sort(
        F.collect_list(
            F.struct("sequence_id", "ordinal", "id", "memory_key", "content", "kind", "importance")
        )
    )
    batches = picked.groupBy(*SESSION).agg(
        F.max("total_tokens").alias("total_tokens"),
        F.sum("tokens").alias("compacted_tokens"),
        F.max("sequence_id").alias("last_sequence_id"),
        items.alias("items"),
    )
    payload = F.to_json(
        F.transform(
            "items",
            lambda m: F.struct(m["id"].alias("id"), m["memory_key"].alias("memory_key"), m["content"].alias("content"),
                               m["kind"].alias("kind"), m["sequence_id"].alias("sequence_id"), m["importance"].alias("importance")),
        )
    )
    provenance = F.to_json(
        F.struct(
            F.lit("llm_working_memory_summary").alias("source"),
            F.transform("items", lambda m: m["id"]).alias("compacted_item_ids"),
            F.transform("items", lambda m: m["memory_key"]).alias("compacted_memory_keys"),
            "compacted_tokens",
            F.col("total_tokens").alias("total_working_memory_tokens"),
            F.lit(settings.compaction_share).alias("compaction_ratio"),
        )
    )
    return batches.select(
        *SESSION,
        "last_sequence_id",
        "compacted_tokens",
        "total_tokens",
        F.size("items").alias("n_items"),
        F.transform("items", lambda m: m["id"]).alias("item_ids"),
        payload.alias("working_memories"),
        provenance.alias("provenance"),
    )


def _context_candidates(items: DataFrame, threshold: int) -> DataFrame:
    """Rows the greedy pick could take at all.

    Among rows of one size it takes the newest ones, and no more than
    ``threshold / size`` of them after the first row. Older rows of that size
    never fit, so dropping them changes nothing and bounds every session.
    """
    limit = F.floor(F.lit(threshold) / F.col("tokens")) + 1
    newest_first = [F.col("sequence_id").desc(), F.col("ordinal").desc()]
    part = items.withColumn("_seg", segment_of(F.col("sequence_id")))
    inside = Window.partitionBy(*SESSION, "tokens", "_seg").orderBy(*newest_first)
    overall = Window.partitionBy(*SESSION, "tokens").orderBy(*newest_first)
    return (
        part.withColumn("_n", F.row_number().over(inside))
        .where(F.col("_n") <= limit)
        .withColumn("_n", F.row_number().over(overall))
        .where(F.col("_n") <= limit)
        .drop("_n", "_seg")
    )


def context_pick(working: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows that fit a session's context: newest first, rows that do not fit are skipped."""
    threshold = max(1, settings.working_token_threshold)
    items = with_tokens(working)
    totals = items.groupBy(*SESSION).agg(F.sum("tokens").alias("total_tokens"))
    candidates = _context_candidates(items, threshold)
    queue = F.reverse(F.array_sort(F.collect_list(F.struct("sequence_id", "ordinal", "id", "tokens"))))
    sessions = candidates.groupBy(*SESSION).agg(queue.alias("queue")).join(totals, SESSION)

    def step(state, m):
        skip = (state["used"] >= threshold) | (
            (F.size(state["taken"]) > 0) & (state["used"] + m["tokens"] > threshold)
        )
        return F.when(skip, state).otherwise(
            F.struct(
                (state["used"] + m["tokens"]).alias("used"), F.concat(state["taken"], F.array(m["id"])).alias("taken")
            )
        )

    picked = F.aggregate(
        "queue",
        F.struct(F.lit(0).cast("int").alias("used"), T.no_strings().alias("taken")),
        step,
        lambda s: s["taken"],
    )
    everything = F.transform("queue", lambda m: m["id"])
    chosen = sessions.select(
        *SESSION, F.explode(F.when(F.col("total_tokens") <= threshold, everything).otherwise(picked)).alias("id")
    )
    return items.join(chosen, [*SESSION, "id"])


# --- recent turns --------------------------------------------------------------------


def recent_turns(runs: DataFrame, n: int = 4) -> DataFrame:
    """``project_id, session_id, session_context``: the last ``n`` turns, oldest first."""
    last = newest(runs, SESSION, [F.col("sequence_id").desc()], n)
    number = F.col("sequence_id").cast("string")
    line = F.concat(
        F.lit("- 用户#"), number, F.lit(": "), T.compact_named(F.col("user_query"), 120),
        F.lit("\n  助手#"), number, F.lit(": "), T.compact_named(F.col("answer"), 160),
    )
    lines = F.array_sort(F.collect_list(F.struct("sequence_id", line.alias("line"))))
    return last.groupBy(*SESSION).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("session_context")
    )


# --- recall ----------------------------------------------------------------------------


def recency_score(updated_at: Column, now: Column) -> Column:
    """``1 / (1 + age in days)``; the clock is a parameter."""
    hours = F.greatest((F.unix_micros(now) - F.unix_micros(updated_at)) / F.lit(3.6e9), F.lit(0.0))
    return 1.0 / (1.0 + hours / 24.0)


def episodic_recall(
    queries: DataFrame, episodic: DataFrame, now: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Best episodes per query ``query_id, project_id, query``: newest ones first, then scored."""
    pool = max(settings.episodic_limit * 4, 12)
    recent = newest(episodic, ["project_id"], [F.col("updated_at").desc(), F.col("id")], pool)
    # Every project keeps at most `pool` rows, so this join multiplies a query by a constant.
    pairs = queries.withColumn("query_tokens", T.tokenize(F.col("query"))).join(recent, "project_id")
    event = T.tokenize(F.concat_ws(" ", "summary", "details"))
    scored = pairs.withColumn(
        "score",
        F.round(
            F.size(F.array_intersect("query_tokens", event)) + 0.6 * recency_score(F.col("updated_at"), now) + F.col("importance"),
            SCORE_DIGITS,
        ),
    )
    order = [F.col("score").desc(), F.col("recency")]
    return newest(scored, ["query_id"], order, settings.episodic_limit, "rank")


def semantic_recall(queries: DataFrame, facts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Best facts per query among the newest of its project; the newest ones where nothing matches.

    Both fused lists are BM25, so a hit gets twice its rank share.
    """
    limit = settings.semantic_limit
    pool = max(limit * 6, 24)
    k = settings.candidates_for(limit)
    # At most ``pool`` rows per project, read by every step below: written once.
    recent = materialized(newest(facts, ["project_id"], [F.col("updated_at").desc(), F.col("id")], pool), "recent-facts")
    corpus = recent.select(
        F.col("id").alias("chunk_id"),
        F.col("recency").alias("pos"),
        F.col("statement").alias("content"),
        F.col("project_id").alias("scope_id"),
    )
    asked = queries.select("query_id", "query", F.col("project_id").alias("scope_id"))
    hits = materialized(search.bm25_search(asked, corpus, k, settings=settings), "fact-hits")
    fused = search.fuse(search.merge_ranked(hits, hits), k)
    scored = fused.join(recent.select(F.col("id").alias("chunk_id"), "importance"), "chunk_id").withColumn(
        "score", F.round(F.col("fusion_score") + F.col("dense_score") + F.col("sparse_score"), SCORE_DIGITS)
    )
    order = [F.col("score").desc(), F.col("importance").desc(), F.col("fusion_rank")]
    ranked = newest(scored, ["query_id"], order, limit, "rank").select("query_id", F.col("chunk_id").alias("id"), "rank", "score")
    unmatched = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    newest_rows = (
        unmatched.join(recent.where(F.col("recency") <= limit).select("project_id", "id", "recency"), "project_id")
        .select("query_id", "id", F.col("recency").alias("rank"), F.lit(None).cast("double").alias("score"))
    )
    chosen = ranked.unionByName(newest_rows).join(queries.select("query_id", "project_id").distinct(), "query_id")
    return chosen.join(recent.drop("recency"), ["project_id", "id"])


# --- upserts and unions ------------------------------------------------------------------


def upsert_facts(drafts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per (project, type, key): the first id, the latest values.

    ``drafts`` need an order: ``sequence_id`` and ``position`` within ``updated_at``.
    """
    key = ["project_id", "fact_type", "memory_key"]
    values = ["session_id", "sequence_id", "statement", "subject", "predicate", "object", "importance", "metadata", "updated_at"]
    fresh = drafts.withColumn(
        "id", stable_id("sm", F.col("project_id"), F.col("fact_type"), F.col("memory_key"))
    )
    order = F.struct("updated_at", "session_id", "sequence_id", "position")
    rows = fresh.select(*key, "id", *values, order.alias("_order"), F.lit(1).alias("_new"))
    if existing is not None:
        start = F.struct(
            "updated_at", "session_id", "sequence_id", F.lit(-1).cast(drafts.schema["position"].dataType).alias("position")
        )
        rows = rows.unionByName(existing.select(*key, "id", *values, start.alias("_order"), F.lit(0).alias("_new")))
    return (
        rows.groupBy(*key)
        .agg(
            F.min_by("id", F.struct("_new", "_order")).alias("id"),
            F.max_by(F.struct(*values), F.struct("_new", "_order")).alias("v"),
        )
        .select("id", *key, "v.*")
    )


def layered_memories(working: DataFrame, episodic: DataFrame, facts: DataFrame) -> DataFrame:
    """The three layers in one shape; sort by ``updated_at`` descending to present them."""
    common = ["id", "project_id", "session_id", "sequence_id", "importance", "updated_at"]
    return (
        working.select(*common, F.lit("working").alias("memory_type"), "memory_key", F.col("content").alias("memory_value"))
        .unionByName(
            episodic.select(
                *common, F.lit("episodic").alias("memory_type"), F.col("event_type").alias("memory_key"), F.col("summary").alias("memory_value")
            )
        )
        .unionByName(
            facts.select(
                *common, F.concat(F.lit("semantic."), "fact_type").alias("memory_type"), "memory_key", F.col("statement").alias("memory_value")
            )
        )
    )


# --- summaries (text produced elsewhere) ----------------------------------------------------

SUMMARY_SCHEMA = (
    "episodic_memories array<struct<event_type:string,summary:string,details:string,importance:string>>, "
    "semantic_memories array<struct<fact_type:string,memory_key:string,statement:string,subject:string,"
    "predicate:string,object:string,importance:string,metadata:string>>"
)


def json_object_text(text: Column) -> Column:
    """Outermost braces of a model reply, code fences removed; NULL when there are none."""
    bare = T.strip(text)
    fenced = F.regexp_replace(F.regexp_replace(bare, f"^```(?i:json)?{T.WS_CLASS}*", ""), f"{T.WS_CLASS}*```$", "")
    body = F.when(F.startswith(bare, F.lit("```")), fenced).otherwise(bare)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))


def coerce_importance(value: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def _filled(value: Column, default: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)


def summary_episodes(batches: DataFrame) -> DataFrame:
    """Episodic rows from ``summary_json`` of compaction batches; items without summary drop out."""
    parsed = batches.withColumn("_s", F.from_json(json_object_text(F.col("summary_json")), SUMMARY_SCHEMA))
    rows = parsed.select(*SESSION, "last_sequence_id", "provenance", F.posexplode_outer("_s.episodic_memories").alias("at", "e")).where("e is not null")
    kept = rows.withColumn("summary", T.compact(F.coalesce("e.summary", F.lit("")), 900)).where(F.col("summary") != "")
    return kept.select(
        stable_id("ep", F.col("session_id"), F.col("last_sequence_id"), F.lit("summary"), F.col("at")).alias("id"),
        *SESSION,
        F.col("last_sequence_id").alias("sequence_id"),
        T.compact(_filled(F.col("e.event_type"), F.lit("working_memory_summary")), 48).alias("event_type"),
        "summary",
        F.to_json(
            F.struct(F.col("provenance"), F.col("e.details").alias("details"), (F.col("at") + 1).alias("llm_memory_index"))
        ).alias("details"),
        coerce_importance(F.col("e.importance"), 0.74).alias("importance"),
    )


def summary_facts(batches: DataFrame) -> DataFrame:
    """Cleaned fact drafts from ``summary_json``; unknown types become plain facts."""
    parsed = batches.withColumn("_s", F.from_json(json_object_text(F.col("summary_json")), SUMMARY_SCHEMA))
    rows = parsed.select(*SESSION, "last_sequence_id", "provenance", F.posexplode_outer("_s.semantic_memories").alias("at", "f")).where("f is not null")
    kept = rows.withColumn("statement", T.compact(F.coalesce("f.statement", F.lit("")), 900)).where(F.col("statement") != "")
    raw_type = T.compact(_filled(F.col("f.fact_type"), F.lit("fact")), 32)
    typed = kept.withColumn("fact_type", F.when(raw_type.isin(*R.FACT_TYPES), raw_type).otherwise(F.lit("fact")))
    default_key = F.concat(F.col("fact_type"), F.lit("_"), T.key_slug(F.col("statement")))
    return typed.select(
        *SESSION,
        F.col("last_sequence_id").alias("sequence_id"),
        F.col("at").alias("position"),
        "fact_type",
        T.compact(_filled(F.col("f.memory_key"), default_key), 64).alias("memory_key"),
        "statement",
        T.compact(_filled(F.col("f.subject"), F.lit("project")), 120).alias("subject"),
        T.compact(_filled(F.col("f.predicate"), F.lit("long_term_memory")), 120).alias("predicate"),
        T.compact(_filled(F.col("f.object"), F.col("statement")), 240).alias("object"),
        coerce_importance(F.col("f.importance"), 0.72).alias("importance"),
        F.to_json(
            F.struct(F.col("provenance"), F.col("f.metadata").alias("metadata"), (F.col("at") + 1).alias("llm_memory_index"))
        ).alias("metadata"),
    )


def drop_compacted(working: DataFrame, picked: DataFrame, episodes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Working rows without the compacted ones of sessions for which something was stored."""
    stored = episodes.select(*SESSION).unionByName(drafts.select(*SESSION)).distinct()
    gone = picked.select(*SESSION, "id").join(stored, SESSION, "left_semi")
    return working.join(gone, [*SESSION, "id"], "left_anti")


# --- context text ------------------------------------------------------------------------------


def working_line() -> Column:
    return F.concat(F.lit("- "), F.col("memory_key"), F.lit(": "), T.compact(F.col("content"), 240))


def episodic_line() -> Column:
    return F.concat(F.lit("- ["), F.col("event_type"), F.lit("] "), T.compact(F.col("summary"), 160))


def semantic_line() -> Column:
    return F.concat(F.lit("- "), F.col("fact_type"), F.lit("."), F.col("memory_key"), F.lit(": "), T.compact(F.col("statement"), 160))


LAYERS = ("Working Memory", "Episodic Memory", "Semantic Memory")


def focused_lines(lines: DataFrame, limit: int = 6) -> DataFrame:
    """Lines about a query: ``query_id, query, layer, line_no, line`` → ``query_id, text, n_lines``.

    ``layer`` is 0 working, 1 episodic, 2 semantic. Queries about memory itself
    fall back to the first lines when none scores.
    """
    terms = lines.select("query_id", "query").distinct().select(
        "query_id", "query", W.memory_terms(F.col("query")).alias("terms"), W.is_memory_intent(F.col("query")).alias("about_memory")
    )
    scored = lines.select("query_id", "layer", "line_no", "line").join(terms, "query_id").withColumn(
        "score", W.memory_line_score(F.col("terms"), F.col("line"))
    )
    best = scored.groupBy("query_id").agg(F.max("score").alias("best"))
    eligible = scored.join(best, "query_id").where(
        (F.col("score") > 0) | ((F.col("best") <= 0) & F.col("about_memory") & (T.strip(F.col("line")) != ""))
    )
    kept = newest(eligible, ["query_id"], [F.col("score").desc(), F.col("layer"), F.col("line_no")], limit, "rank")
    entries = F.array_sort(F.collect_list(F.struct("layer", "rank", "line")))

    def block(i: int) -> Column:
        mine = F.filter("entries", lambda e: e["layer"] == i)
        return F.when(
            F.size(mine) > 0,
            F.concat(F.array(F.lit(f"### Relevant {LAYERS[i]}")), F.transform(mine, lambda e: e["line"])),
        ).otherwise(T.no_strings())

    found = kept.groupBy("query_id").agg(entries.alias("entries")).select(
        "query_id",
        F.array_join(F.concat(*[block(i) for i in range(len(LAYERS))]), "\n").alias("text"),
        F.size("entries").alias("n_lines"),
    )
    nothing = F.concat(F.lit("没有找到与“"), T.compact_named(F.col("query"), 80), F.lit("”直接相关的项目记忆。"))
    return terms.join(found, "query_id", "left").select(
        "query_id", F.coalesce("text", nothing).alias("text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")
    )


def _block(rows: DataFrame, key: str, order: list[str], line: Column, name: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias(name))


def memory_context(
    queries: DataFrame,
    working: DataFrame,
    episodic: DataFrame,
    facts: DataFrame,
    runs: DataFrame,
    now: Column,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Context blocks per query ``query_id, project_id, session_id, query``."""
    picked = queries.select("query_id", *SESSION).join(context_pick(working, settings), SESSION)
    w = _block(picked, "query_id", ["sequence_id", "ordinal"], working_line(), "working_context")
    e = _block(episodic_recall(queries, episodic, now, settings), "query_id", ["rank"], episodic_line(), "episodic_context")
    s = _block(semantic_recall(queries, facts, settings), "query_id", ["rank"], semantic_line(), "semantic_context")
    joined = (
        queries.join(recent_turns(runs), SESSION, "left").join(w, "query_id", "left").join(e, "query_id", "left").join(s, "query_id", "left")
    )
    working_text = F.coalesce("working_context", F.lit("- no working memory yet"))
    blocks = joined.select(
        *queries.columns,
        T.excerpt(F.col("session_context"), "- no prior turns yet", 900).alias("session_context"),
        working_text.alias("working_context"),
        T.excerpt(F.col("episodic_context"), "- no episodic memory yet", 1200).alias("episodic_context"),
        T.excerpt(F.col("semantic_context"), "- no semantic memory yet", 1200).alias("semantic_context"),
    )
    return blocks.withColumn(
        "memory_context",
        F.concat_ws(
            "\n\n", F.lit("Working Memory"), "working_context", F.lit("Episodic Memory"), "episodic_context",
            F.lit("Semantic Memory"), "semantic_context",
        ),
    )
