"""Question understanding, rewriting, evidence with parent context, replanning and retrieval metrics.

Questions are derived from the benchmark texts: each text is put into one of
the question frames below, so that every intent class occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS
from inkwell.functions import rewrite as W
from inkwell.functions import rules as R
from inkwell.functions import text as T
from inkwell.operators import chunking as C
from inkwell.operators import evaluation as E
from inkwell.operators import evidence as V
from inkwell.session import materialized, table
from inkwell.workload import chunk_sql as CS
from inkwell.workload import sqltext as S
from inkwell.workload.registry import register
from inkwell.workload.retrieval_queries import benchmark_queries, documents

FRAMES = (
    "{}", "《{}》的第一作者是谁", "{} 分为哪两类？", "低信噪比时 {} 为什么稳？", "{} 如何少传比特但不影响理解", "{} 和传统通信的区别",
    "它未来怎么发展？ {}", "{} 的系统架构", "{} 为什么选这个算法", "{} benchmark 指标", "{} privacy 风险", "请介绍一下{}",
)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    base = benchmark_queries(spark, sf)
    frame = F.element_at(T.lits(FRAMES), (F.col("query_id") % len(FRAMES) + 1).cast("int"))
    return base.select("query_id", F.replace(frame, F.lit("{}"), F.col("query")).alias("query"))


_FRAME_LIST = "[" + ", ".join(S.quoted(f) for f in FRAMES) + "]"
QUESTIONS = f"""questions AS (
      SELECT item_id AS query_id, replace(({_FRAME_LIST})[item_id % {len(FRAMES)} + 1], '{{}}', text) AS query, '' AS todo
      FROM benchmark)"""


def _intent_sql(x: str) -> str:
    cases = " ".join(
        f"WHEN {S.contains_any(x, terms)}" + (f" OR {S.contains_any(f'lower({x})', lower)}" if lower else "") + f" THEN '{name}'"
        for name, terms, lower in R.INTENT_RULES
    )
    return f"(CASE {cases} ELSE '{R.DEFAULT_INTENT}' END)"


@register("intent_class", f"WITH {QUESTIONS} SELECT query_id, {_intent_sql('query')} AS intent FROM questions")
def intent_class(spark, sf):
    return questions(spark, sf).select("query_id", W.intent(F.col("query")).alias("intent"))


TITLE = S.strip(f"regexp_extract(query, {S.quoted(W.QUOTED_TITLE)}, 1)")
BARE = f"regexp_replace(query, {S.quoted(W.PUNCTUATION)}, ' ', 'g')"
LOOKUP = S.contains_any("query", R.LOOKUP_TERMS)


def _focus(limit: int) -> str:
    return f"(CASE WHEN {TITLE} <> '' THEN {TITLE} ELSE {S.compact_named('query', limit)} END)"


def _planned_sql(suffixes) -> str:
    return (
        f"[query, {_focus(96)}, {S.compact_named(BARE, 96)}, "
        + ", ".join(f"{_focus(96)} || {S.quoted(' ' + s)}" for s in suffixes)
        + ", todo]"
    )


PLANNED = f"""planned_raw AS (
      SELECT *, unnest(CASE WHEN {LOOKUP} THEN {_planned_sql(R.LOOKUP_SUFFIXES)} ELSE {_planned_sql(R.GENERAL_SUFFIXES)} END) AS item,
             generate_subscripts(CASE WHEN {LOOKUP} THEN {_planned_sql(R.LOOKUP_SUFFIXES)} ELSE {_planned_sql(R.GENERAL_SUFFIXES)} END, 1) AS n
      FROM questions),
    planned AS (
      SELECT query_id, {S.collapse('item')} AS item, min(n) AS n FROM planned_raw
      WHERE {S.collapse('item')} <> '' GROUP BY query_id, {S.collapse('item')})"""


@register("planned_queries", f"WITH {QUESTIONS}, {PLANNED} SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM planned")
def planned_queries(spark, sf):
    q = F.col("query")
    plan = W.planned_queries(q, q, F.lit(""))
    rows = questions(spark, sf).select("query_id", F.posexplode_outer(plan).alias("at", "item"))
    return rows.select("query_id", "item", (F.col("at") + 1).cast("bigint").alias("place"))


def _expansion_sql() -> str:
    text = "(query || ' ' || query)"
    low = f"lower({text})"
    parts = []
    for rule in R.EXPANSIONS:
        tests = ["true"] if rule.always else []
        tests += [S.contains_any(text, rule.text)] if rule.text else []
        tests += [S.contains_any(low, rule.lower)] if rule.lower else []
        if rule.lower_unless:
            tests.append(f"(contains({low}, '{rule.lower_unless[0]}') AND NOT contains({low}, '{rule.lower_unless[1]}'))")
        cond = "(" + " OR ".join(tests) + ")"
        cond += f" AND intent = '{rule.intent}'" if rule.intent else ""
        cond += f" AND intent <> '{rule.not_intent}'" if rule.not_intent else ""
        parts.append(f"CASE WHEN {cond} THEN [{', '.join(S.quoted(t) for t in rule.terms)}] ELSE [] END")
    gate = f"({S.contains_any(text, R.EXPANSION_GATE_TEXT)} OR {S.contains_any(low, R.EXPANSION_GATE_LOWER)})"
    return f"CASE WHEN {gate} THEN {_keep_first('flatten([' + ', '.join(parts) + '])')} ELSE [] END"


def _keep_first(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _case(template, default, build) -> str:
    whens = " ".join(f"WHEN intent = '{k}' THEN {build(v)}" for k, v in template.items())
    return f"CASE {whens} ELSE {build(default)} END"


def _variants_sql() -> str:
    focus100, focus120 = _focus(100), _focus(120)
    bare160 = S.compact_named(BARE, 160)
    vague = f"({S.contains_any('query', R.PRONOUN_TERMS)} OR length({bare160}) < 18)"
    standalone = (
        f"CASE WHEN {vague} AND {focus120} <> '' AND NOT contains({bare160}, {focus120}) "
        f"THEN {S.compact_named(f'{focus120} || chr(32) || {bare160}', 180)} ELSE {bare160} END"
    )
    noise = f"({S.contains_any('lower(query)', R.HYDE_NOISE_LOWER)} OR {S.contains_any('query', R.HYDE_NOISE_TEXT)})"
    added = f"array_to_string(list_slice(terms, 1, {R.HYDE_EXPANSIONS}), ' ')"
    hyde = _case(
        R.HYDE, R.HYDE_DEFAULT,
        lambda t: S.compact_named(f"focus || {S.quoted(t[0])}" + (f" || {added}" if t[2] else ""), t[1]),
    )
    hyde = f"CASE WHEN intent = 'robustness' AND {noise} THEN {S.compact_named(f'focus || {S.quoted(R.HYDE_NOISE[0])}', R.HYDE_NOISE[1])} ELSE {hyde} END"
    step = _case(R.STEP_BACK, R.STEP_BACK_DEFAULT, lambda t: S.compact_named(f"focus || {S.quoted(t)}", R.STEP_BACK_LIMIT))
    toks = (
        f"list_concat(regexp_extract_all(query || ' ' || query, {S.quoted(T.CJK_RUN)}), "
        f"regexp_extract_all(lower(query || ' ' || query), {S.quoted(T.LATIN_TOKEN)}))"
    )
    def row(n, strategy, text, where="true"):
        return (
            f"SELECT query_id, intent, {n} AS n, '{strategy}' AS strategy, {R.VARIANTS[strategy][0]}::DOUBLE AS weight, "
            f"{S.compact_named(text, W.VARIANT_LIMIT)} AS query FROM staged2 WHERE {where}"
        )

    return f"""{QUESTIONS}, {PLANNED},
    staged AS MATERIALIZED (SELECT *, {_intent_sql('query')} AS intent, {focus100} AS focus, {standalone} AS standalone FROM questions),
    staged1 AS MATERIALIZED (SELECT *, {_expansion_sql()} AS terms, {toks} AS toks FROM staged),
    staged2 AS MATERIALIZED (SELECT *, {step} AS step_back, {hyde} AS hyde,
      array_to_string(list_slice({_keep_first('list_concat(toks, terms)')}, 1, {R.LEXICAL_TERMS}), ' ') AS lexical FROM staged1),
    candidates AS (
      SELECT p.query_id, intent, n, 'baseline_expansion' AS strategy, 1.0::DOUBLE AS weight, {S.compact_named('item', W.VARIANT_LIMIT)} AS query
      FROM planned p JOIN staged2 USING (query_id)
      UNION ALL {row(100, 'standalone', 'standalone')}
      UNION ALL {row(101, 'step_back', 'step_back')}
      UNION ALL {row(102, 'lexical_domain_expansion', S.compact_named('lexical', 220))}
      UNION ALL {row(103, 'hyde', 'hyde', "intent NOT IN ('lookup', 'taxonomy')")}),
    kept AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(query) ORDER BY n) AS dup FROM candidates) WHERE dup = 1),
    variants AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, n) AS query_no FROM kept)
      WHERE query_no <= {DEFAULTS.max_query_variants})"""


@register("rewrite_variants", f"WITH {_variants_sql()} SELECT query_id, query_no, strategy, weight, intent, query FROM variants")
def rewrite_variants(spark, sf):
    return W.rewrite_queries(questions(spark, sf)).select(
        "query_id", F.col("query_no").cast("bigint").alias("query_no"), "strategy", "weight", "intent", "query"
    )


# --- chunks and evidence -------------------------------------------------------------


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as assets. Lines that open a paragraph of the source stay as they are."""
    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("asset_id"),
        F.concat(F.lit("document "), F.col("doc_id")).alias("title"),
        F.col("source").alias("asset_type"),
        F.col("text").alias("content"),
        F.col("doc_id").alias("asset_pos"),
    )


@register(
    "chunk_documents",
    f"""WITH RECURSIVE {CS.CHUNKS}
    SELECT doc_id::VARCHAR AS asset_id, chunk_id, title, asset_type, text AS content, source_path, chunk_level, parent_id, '正文' AS section_path,
      0 AS page_start, 0 AS page_end, size::BIGINT AS token_count, doc_id * 1073741824 + number AS pos FROM chunks""",
)
def chunk_documents(spark, sf):
    rows = C.chunk_documents(assets(spark, sf))
    return rows.withColumn("token_count", F.col("token_count").cast("bigint"))


@register(
    "section_split",
    f"""WITH lines AS (
      SELECT doc_id, unnest(regexp_split_to_array(regexp_replace({S.strip('text')}, '\r\n?', '\n', 'g'), '\n')) AS line,
             generate_subscripts(regexp_split_to_array(regexp_replace({S.strip('text')}, '\r\n?', '\n', 'g'), '\n'), 1) AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 1 THEN lang || ' / ' || source ELSE lang || ' / ' || source || ' / ' || n END AS heading,
           {S.strip('line')} AS body
    FROM lines JOIN documents USING (doc_id) WHERE {S.strip('line')} <> ''""",
)
def section_split(spark, sf):
    """Documents turned into outlines (language, source, one heading per line) and split back into sections."""
    lines = F.split(F.regexp_replace(T.strip(F.col("text")), "\r\n?", "\n"), "\n")
    outlined = F.transform(
        lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("### "), (i + 1).cast("string"), F.lit("\n"), x))
    )
    docs = documents(spark, sf).select(
        "doc_id",
        F.concat(F.lit("# "), "lang", F.lit("\n## "), "source", F.lit("\n"), F.array_join(outlined, "\n")).alias("content"),
    )
    return C.section_rows(docs).select("doc_id", "heading", "body")


@register("sentence_rows", f"WITH {CS.SENTENCES} SELECT doc_id, \"at\", text, len({CS.rough('text')}) AS n_tokens FROM sentences")
def sentence_rows(spark, sf):
    spans = C.sentence_spans(F.col("text"))
    return documents(spark, sf).select("doc_id", F.posexplode_outer(spans).alias("at", "s")).where("s is not null").select(
        "doc_id", "at", "s.text", F.col("s.size").alias("n_tokens")
    )


_MERGED = f"""
    dense AS ({S.top_k('overlap', 20)}),
    sparse AS ({S.top_k('bm25', 20)}),
    {S.fusion_ctes(20)},
    hits AS ({S.reranked(5)}),
    boosted AS (
      SELECT s.query_id, h.chunk_id, s.query_no, h.rank, s.query AS matched_query,
             round(h.score * greatest(weight, 0.05) + 0.02::DOUBLE / query_no + 0.01::DOUBLE / rank, 9) AS boosted
      FROM searches s JOIN hits h ON h.query_id = s.query),
    merged AS (
      SELECT query_id, chunk_id, max(boosted) AS score, arg_max(query_no, (boosted, -query_no, -rank)) AS query_no,
             min((query_no, rank)) AS first_seen FROM boosted GROUP BY query_id, chunk_id)"""

_MERGE_SQL = f"""
    searches AS (
      SELECT item_id AS query_id, 1 AS query_no, text AS query, 1.0::DOUBLE AS weight FROM benchmark
      UNION ALL SELECT item_id, 2, {S.compact_named('text', 96)}, 0.68::DOUBLE FROM benchmark),
    {S.search_ctes("SELECT doc_id AS chunk_id, doc_id AS pos, text AS content FROM documents",
                   "SELECT DISTINCT query AS query_id, query FROM searches")},
    {_MERGED}"""


_WHOLE, _PART = S.collapse("p.text"), S.collapse("c.text")
_EVIDENCE_SQL = f"""WITH RECURSIVE {_variants_sql()}, {CS.CHUNKS},
    searches AS (SELECT query_id, query_no, query, weight FROM variants),
    {S.search_ctes("SELECT chunk_id, doc_id * 1073741824 + number AS pos, text AS content FROM chunks WHERE chunk_level = 'child'",
                   "SELECT DISTINCT query AS query_id, query FROM searches")},
    {_MERGED},
    ranked_chunks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM merged) WHERE rank <= 5),
    found_texts AS (
      SELECT query_id, 'C' || r.rank AS label, r.rank, r.chunk_id, c.title, c.source_path, round(r.score, 4) AS score, {_WHOLE} AS whole, instr({_WHOLE}, substring({_PART}, 1, 160)) - 1 AS found_at
      FROM ranked_chunks r JOIN chunks c ON c.chunk_id = r.chunk_id JOIN chunks p ON p.chunk_id = c.parent_id),
    cuts AS (SELECT *, least(greatest(found_at - {DEFAULTS.snippet_chars // 3}, 0) + {DEFAULTS.snippet_chars}, length(whole)) AS upto FROM found_texts)"""
_SNIPPET = f"""CASE WHEN length(whole) <= {DEFAULTS.snippet_chars} THEN whole WHEN found_at < 0 THEN {S.strip(f"substring(whole, 1, {DEFAULTS.snippet_chars})")}
      ELSE CASE WHEN upto > {DEFAULTS.snippet_chars} THEN '...' ELSE '' END ||
        {S.strip(f"substring(whole, greatest(upto - {DEFAULTS.snippet_chars}, 0) + 1, least(upto, {DEFAULTS.snippet_chars}))")} ||
        CASE WHEN upto < length(whole) THEN '...' ELSE '' END END"""


@register(
    "evidence_context",
    f"{_EVIDENCE_SQL} SELECT query_id, label, rank, chunk_id, title, {_SNIPPET} AS snippet, source_path, score FROM cuts",
)
def evidence_context(spark, sf):
    """Flagship pipeline: chunk, rewrite, hybrid search, weighted merge, parent context, labels."""
    chunks = materialized(C.chunk_documents(assets(spark, sf)), "chunks")
    rows = V.retrieve(W.rewrite_queries(questions(spark, sf)), chunks)
    return rows.select("query_id", "label", "rank", "chunk_id", "title", "snippet", "source_path", "score")


@register(
    "retrieve_with_replan",
    # The driver questions find strong evidence at once; a second pass would show as a difference.
    f"{_EVIDENCE_SQL} SELECT query_id, label, rank, chunk_id, score, false AS replanned, false AS from_retry FROM cuts",
)
def retrieve_with_replan(spark, sf):
    chunks = materialized(C.chunk_documents(assets(spark, sf)), "chunks")
    rows = V.retrieve_with_replan(questions(spark, sf), chunks)
    return rows.select("query_id", "label", "rank", "chunk_id", "score", "replanned", "from_retry")


@register(
    "multi_query_merge",
    f"""WITH {_MERGE_SQL}
    SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM merged) WHERE rank <= 5""",
)
def multi_query_merge(spark, sf):
    """Two weighted searches per benchmark text, merged into one list per text."""
    from inkwell.workload.retrieval_queries import document_chunks

    base = benchmark_queries(spark, sf)
    searches = base.select("query_id", F.lit(1).alias("query_no"), "query", F.lit(1.0).alias("weight")).unionByName(
        base.select("query_id", F.lit(2).alias("query_no"), T.compact_named(F.col("query"), 96).alias("query"), F.lit(0.68).alias("weight"))
    )
    merged = V.merge_searches(V.weighted_searches(searches, document_chunks(spark, sf)), DEFAULTS.retrieval_limit)
    return merged.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


@register(
    "retrieval_strategies",
    f"""WITH {_MERGE_SQL},
    strategy_lists AS (
      SELECT 'rewritten' AS strategy, query_id, chunk_id, score, first_seen FROM merged
      UNION ALL SELECT 'plain', query_id, chunk_id, max(boosted), min((query_no, rank)) FROM boosted WHERE query_no = 1 GROUP BY query_id, chunk_id),
    shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, first_seen) AS place FROM strategy_lists) WHERE place <= 5),
    found AS (
      SELECT strategy, query_id, min(place) FILTER (WHERE contains(d.text, b.text)) AS first, bool_or(place = 1 AND doc_id % 7 = 0) AS drift
      FROM shown s JOIN documents d ON d.doc_id = s.chunk_id JOIN benchmark b ON b.item_id = s.query_id GROUP BY strategy, query_id)
    SELECT t.strategy, item_id AS case_id, coalesce((first <= 1)::INT, 0)::DOUBLE AS hit1, coalesce((first <= 5)::INT, 0)::DOUBLE AS hit5,
      coalesce(1.0::DOUBLE / first, 0) AS mrr5, coalesce(first, 999) AS top_gold_rank, coalesce(drift::INT, 0)::DOUBLE AS drift
    FROM benchmark CROSS JOIN (VALUES ('plain'), ('rewritten')) t(strategy) LEFT JOIN found f ON f.strategy = t.strategy AND f.query_id = item_id""",
)
def retrieval_strategies(spark, sf):
    """One search or two weighted ones per benchmark text; every seventh document counts as a distractor."""
    from inkwell.plans import jobs
    from inkwell.workload.retrieval_queries import document_chunks

    base = benchmark_queries(spark, sf)
    plain = base.select("query_id", F.lit(1).alias("query_no"), "query", F.lit(1.0).alias("weight"))
    short = base.select("query_id", F.lit(2).alias("query_no"), T.compact_named(F.col("query"), 96).alias("query"), F.lit(0.68).alias("weight"))
    chunks = document_chunks(spark, sf).select(
        "*", F.when(F.col("chunk_id") % 7 == 0, "DIST: other").otherwise("document").alias("title"), F.lit("note").alias("asset_type"),
        F.lit("").alias("source_path"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("child").alias("chunk_level"),
    )
    gold = base.select(F.col("query_id").alias("case_id"), F.col("query").alias("marker"))
    rows = jobs.evaluate_retrieval(gold.select("case_id"), gold, {"plain": plain, "rewritten": plain.unionByName(short)}, chunks)
    return rows.select("strategy", "case_id", "hit1", "hit5", "mrr5", F.col("top_gold_rank").cast("bigint").alias("top_gold_rank"), "drift")


_METRIC_CASES = f"""WITH {S.search_ctes("SELECT doc_id AS chunk_id, doc_id AS pos, text AS content FROM documents",
                                  "SELECT item_id AS query_id, text AS query FROM benchmark")},
    dense AS ({S.top_k('overlap', 20)}), sparse AS ({S.top_k('bm25', 20)}), {S.fusion_ctes(20)},
    hybrid AS ({S.reranked(5)}),
    shown AS (
      SELECT 'overlap' AS strategy, query_id, chunk_id, rank FROM dense WHERE rank <= 5
      UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM sparse WHERE rank <= 5
      UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hybrid),
    found AS (
      SELECT strategy, query_id, min(rank) AS first FROM shown l JOIN documents d ON d.doc_id = l.chunk_id
      JOIN benchmark b ON b.item_id = l.query_id WHERE contains(d.text, b.text) GROUP BY strategy, query_id),
    cases AS (
      SELECT s.strategy, b.item_id AS query_id, f.first FROM benchmark b
      CROSS JOIN (VALUES ('overlap'), ('bm25'), ('hybrid')) s(strategy)
      LEFT JOIN found f ON f.strategy = s.strategy AND f.query_id = b.item_id)"""


def _metric_rows(spark, sf):
    from inkwell.operators import retrieval as RT
    from inkwell.workload.retrieval_queries import document_chunks

    docs, asked = document_chunks(spark, sf), benchmark_queries(spark, sf)
    k = DEFAULTS.candidate_limit
    lists = materialized(RT.ranked_lists(RT.best_pairs(asked, docs, k), k), "lists")
    hybrid = RT.rerank_by_sum(RT.fuse(lists, k), 5).select(F.lit("hybrid").alias("strategy"), "query_id", "chunk_id", "rank")
    both = lists.select(F.lit("overlap").alias("strategy"), "query_id", "chunk_id", F.col("dense_rank").alias("rank")).unionByName(
        lists.select(F.lit("bm25").alias("strategy"), "query_id", "chunk_id", F.col("sparse_rank").alias("rank"))
    )
    ranked = hybrid.unionByName(both.where(F.col("rank") <= 5))
    case_id = F.struct("strategy", "query_id")
    evidence = ranked.join(docs.select("chunk_id", "content"), "chunk_id").select(case_id.alias("case_id"), "rank", "content")
    strategies = F.explode(T.lits(("overlap", "bm25", "hybrid"))).alias("strategy")
    gold = asked.select("query_id", F.col("query").alias("marker"), strategies).select(case_id.alias("case_id"), "marker")
    return E.retrieval_metrics(gold.select("case_id"), evidence, gold, F.col("content"))


@register(
    "retrieval_metrics",
    f"""{_METRIC_CASES} SELECT strategy, query_id, coalesce((first <= 1)::INT, 0)::DOUBLE AS hit1, coalesce((first <= 3)::INT, 0)::DOUBLE AS hit3,
      coalesce((first <= 5)::INT, 0)::DOUBLE AS hit5, coalesce(1.0::DOUBLE / first, 0) AS mrr5,
      coalesce((first <= 5)::INT, 0)::DOUBLE AS coverage5, coalesce(first, 999) AS top_gold_rank FROM cases""",
)
def retrieval_metrics(spark, sf):
    """Gold is a document that contains the benchmark text."""
    return _metric_rows(spark, sf).select(
        "case_id.strategy", "case_id.query_id", "hit1", "hit3", "hit5", "mrr5", "coverage5",
        F.col("top_gold_rank").cast("bigint").alias("top_gold_rank"),
    )


@register(
    "retrieval_summary",
    f"""{_METRIC_CASES} SELECT strategy, count(*) AS n_cases, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS hit1,
      round(avg(coalesce((first <= 5)::INT, 0)), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr5,
      round(avg(coalesce(first, 999)), 6) AS avg_rank, round(stddev_pop(coalesce(first, 999)), 6) AS rank_stdev,
      0.0::DOUBLE AS drift_rate FROM cases GROUP BY strategy""",
)
def retrieval_summary(spark, sf):
    rows = _metric_rows(spark, sf).withColumn("strategy", F.col("case_id.strategy"))
    s = E.summarize_metrics(rows, ["strategy"])
    return s.select(
        "strategy", "n_cases", *[F.round(c, 6).alias(c) for c in ("hit1", "hit5", "mrr5", "avg_rank", "rank_stdev", "drift_rate")]
    )


def _pass_sql(kind: str) -> str:
    return f"""SELECT user_id AS query_id, event_id AS chunk_id, rank, round(value / 50, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_type = '{kind}') WHERE rank <= {DEFAULTS.retrieval_limit}"""


def _strength_sql(source: str) -> str:
    return f"SELECT query_id, arg_min(score, rank) AS top, round(arg_min(score, rank) + 0.05 * least(count(*), {DEFAULTS.retrieval_limit}), 9) AS strength FROM {source} GROUP BY query_id"


@register(
    "replan_choice",
    f"""WITH q AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN '作者 ' || c_name ELSE c_name END AS query FROM customer WHERE c_custkey < 300),
    f AS ({_pass_sql('click')}), r AS ({_pass_sql('view')}), before AS ({_strength_sql('f')}), after AS ({_strength_sql('r')}),
    weak AS (SELECT query_id FROM q LEFT JOIN before USING (query_id) WHERE top IS NULL OR top < CASE WHEN contains(query, '作者') THEN {V.LOOKUP_THRESHOLD} ELSE {V.GENERAL_THRESHOLD} END),
    verdict AS (SELECT query_id, coalesce(a.strength, 0) >= coalesce(b.strength, 0) AS wins FROM weak LEFT JOIN before b USING (query_id) LEFT JOIN after a USING (query_id))
    SELECT f.*, wins IS NOT NULL AS replanned, false AS from_retry FROM f LEFT JOIN verdict USING (query_id) WHERE NOT coalesce(wins, false)
    UNION ALL SELECT r.*, true, true FROM r JOIN verdict USING (query_id) WHERE wins""",
)
def replan_choice(spark, sf):
    """Weak first passes against their retries: clicks of a user are the first pass, views the second one."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("作者 "), "c_name")).otherwise(F.col("c_name"))
    asked = table(spark, sf, "customer").where("c_custkey < 300").select(F.col("c_custkey").alias("query_id"), name.alias("query"))
    order = Window.partitionBy("user_id").orderBy("event_id")

    def evidence(kind):
        rows = table(spark, sf, "events").where(F.col("event_type") == kind).withColumn("rank", F.row_number().over(order))
        return rows.where(F.col("rank") <= DEFAULTS.retrieval_limit).select(
            F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), "rank", F.round(F.col("value") / 50, 4).alias("score")
        )

    first, retry = evidence("click"), evidence("view")
    return V.stronger_pass(V.weak_queries(asked, first), first, retry)
