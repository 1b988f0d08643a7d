"""Counts, listings, checks, deletes, uploads, splits and text functions over the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import decisions as D
from inkwell.functions import text as T
from inkwell.operators import alignment as A
from inkwell.operators import evidence as V
from inkwell.operators import uploads as U
from inkwell.operators import workspace as WS
from inkwell.plans import jobs
from inkwell.session import checkpoint_root, table
from inkwell.sources import ingest
from inkwell.workload import sqltext as S
from inkwell.workload.memory_queries import RUNS, runs
from inkwell.workload.registry import register


@register(
    "project_counts",
    """SELECT c_custkey, count(o_orderkey) AS n_runs, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS n_open
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def project_counts(spark, sf):
    """Customers stand for projects, orders for runs."""
    parents = table(spark, sf, "customer").select("c_custkey")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return WS.with_counts(parents, "c_custkey", n_runs=orders, n_open=orders.where(F.col("o_orderstatus") == "O"))


@register(
    "latest_per_parent",
    """SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 20""",
)
def latest_per_parent(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    rows = WS.listing(orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], limit=20)
    return rows.select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


@register("newest_assets", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id DESC LIMIT 20")
def newest_assets(spark, sf):
    return WS.first_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("doc_id").desc()], 20)


@register(
    "referential_checks",
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
      SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')""",
)
def referential_checks(spark, sf):
    """Orders whose customer is not among the non-building customers."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parents = table(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return WS.missing_parent(orders, parents, {"o_custkey": "c_custkey"})


@register(
    "sequence_guard",
    """WITH t AS (SELECT conv_id, turn, count(*) AS n FROM (
      SELECT conv_id, turn FROM conversations WHERE role <> 'system' UNION ALL
      SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND conv_id % 9 = 0) GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN n > 1 THEN 'duplicate' ELSE 'gap' END AS violation FROM t
    WHERE n > 1 OR (turn <> 1 AND NOT EXISTS (SELECT 1 FROM t p WHERE p.conv_id = t.conv_id AND p.turn = t.turn - 1))""",
)
def sequence_guard(spark, sf):
    """Turns as sequence numbers; some assistant turns arrive twice, and sessions that start at 0 show a gap."""
    turns = table(spark, sf, "conversations").where(F.col("role") != "system").select("conv_id", "turn", "role")
    again = turns.where((F.col("role") == "assistant") & (F.col("conv_id") % 9 == 0))
    return WS.sequence_violations(turns.unionByName(again), "conv_id", "turn")


@register(
    "session_delete",
    f"""WITH {RUNS}, gone AS (SELECT session_id FROM runs GROUP BY session_id HAVING max(sequence_id) = 1),
    todos AS (SELECT session_id, sequence_id, session_id || '-' || sequence_id AS last_run_id FROM runs)
    SELECT session_id, sequence_id, CASE WHEN session_id IN (SELECT session_id FROM gone) THEN NULL ELSE last_run_id END AS last_run_id FROM todos""",
)
def session_delete(spark, sf):
    """One-turn sessions are deleted; to-dos that point at their runs lose the pointer."""
    base = runs(spark, sf).withColumn("run_id", F.concat_ws("-", "session_id", F.col("sequence_id").cast("string")))
    gone = base.groupBy("session_id").agg(F.max("sequence_id").alias("n")).where(F.col("n") == 1)
    todos = base.select("session_id", "sequence_id", F.col("run_id").alias("last_run_id"))
    return WS.delete_sessions(gone, base.select("session_id").distinct(), base, base, todos)["todos"]


@register(
    "project_delete",
    f"""WITH {RUNS} SELECT 'runs' AS name, count(*) AS n FROM runs WHERE project_id NOT IN ('p0', 'p1')
    UNION ALL SELECT 'assets', count(*) FROM documents""",
)
def project_delete(spark, sf):
    base = runs(spark, sf)
    deleted = base.where(F.col("project_id").isin("p0", "p1")).select("project_id")
    left = WS.delete_projects(deleted, {"runs": base, "assets": table(spark, sf, "documents")})
    counts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@register(
    "session_rollup",
    f"""WITH {RUNS} SELECT session_id, {S.compact_named("arg_min(user_query, sequence_id)", 48)} AS title,
      {S.compact_named("arg_max(answer, sequence_id)", 160)} AS summary, max(sequence_id) AS last_sequence_id FROM runs GROUP BY session_id""",
)
def session_rollup(spark, sf):
    base = runs(spark, sf)
    sessions = base.select("session_id").distinct().select(
        "session_id", F.lit(WS.DEFAULT_SESSION_TITLE).alias("title"), F.lit("").alias("summary")
    )
    return WS.session_rollup(base, sessions)


@register(
    "append_updates",
    f"""WITH {RUNS} SELECT session_id, sequence_id, CASE WHEN sequence_id % 2 = 0 THEN 'query,answer,summary,fact' ELSE 'query,answer' END AS updates FROM runs""",
)
def append_updates(spark, sf):
    base = runs(spark, sf).withColumn("memory_updates", T.lits(("query", "answer")))
    late = base.where(F.col("sequence_id") % 2 == 0).select(
        "project_id", "session_id", "sequence_id", F.posexplode(T.lits(("summary", "fact"))).alias("position", "update")
    )
    return WS.append_updates(base, late).select("session_id", "sequence_id", F.array_join("memory_updates", ",").alias("updates"))


@register(
    "run_rollups",
    """SELECT user_id::VARCHAR AS run_id, count(*) FILTER (WHERE event_type = 'click') AS n_decisions,
      count(*) FILTER (WHERE event_type = 'view') AS n_calls, count(*) FILTER (WHERE event_type = 'purchase') AS n_evidence
    FROM events GROUP BY user_id""",
)
def run_rollups(spark, sf):
    """Users stand for runs, their events for trace steps."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", "event_type")
    names = F.when(F.col("event_type") == "click", "agent_decision").when(F.col("event_type") == "view", "agent_observation").otherwise("other")
    trace = e.select("run_id", F.col("event_id").alias("step_no"), names.alias("action"), F.lit("Observation: view").alias("title"))
    kept = e.where(F.col("event_type") == "purchase")
    return WS.run_rollups(trace, kept).select("run_id", "n_decisions", "n_calls", "n_evidence")


@register(
    "last_entries",
    """SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS entries FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 8 GROUP BY user_id""",
)
def last_entries(spark, sf):
    rows = WS.last_entries(table(spark, sf, "events"), "user_id", "event_id", 8, ["event_type"])
    shown = F.transform("entries", lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["event_type"]))
    return rows.select("user_id", F.array_join(shown, ",").alias("entries"))


@register(
    "plan_rows",
    f"""WITH {RUNS}, t(task_no, title, output_key) AS (VALUES (1, 'Clarify objective', 'objective'), (2, 'Collect evidence', 'evidence'),
      (3, 'Validate and align', 'aligned_evidence'), (4, 'Synthesize answer', 'final_answer'))
    SELECT session_id || '-' || sequence_id AS run_id, task_no::BIGINT AS task_no, title, output_key, 'completed' AS status,
      CASE WHEN task_no = 1 THEN '明确本轮问题的求解目标与答案类型：' || user_query END AS subject_goal FROM runs, t""",
)
def plan_rows(spark, sf):
    turns = runs(spark, sf).select(
        F.concat_ws("-", "session_id", F.col("sequence_id").cast("string")).alias("run_id"), F.col("user_query").alias("subject")
    )
    rows = WS.plan_rows(turns, "two_stage", completed=True)
    return rows.select(
        "run_id", F.col("task_no").cast("bigint").alias("task_no"), "title", "output_key", "status",
        F.when(F.col("task_no") == 1, F.col("goal")).alias("subject_goal"),
    )


@register(
    "validation",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT length(title) BETWEEN 1 AND 120 THEN 'title_length' END,
      CASE WHEN length(content) < 1 THEN 'content_empty' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents
      UNION ALL SELECT doc_id + 10000000, '', text FROM documents WHERE doc_id % 10 = 0
      UNION ALL SELECT doc_id + 20000000, split_part(text, chr(10), 1), '' FROM documents WHERE doc_id % 15 = 0)""",
)
def validation(spark, sf):
    """First lines as titles and whole texts; empty titles and contents are further rows."""
    docs = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"))
    rows = docs.unionByName(docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("").alias("title"), "content"))
    rows = rows.unionByName(docs.where("doc_id % 15 = 0").select((F.col("doc_id") + 20_000_000).alias("doc_id"), "title", F.lit("").alias("content")))
    return WS.validate(rows, WS.asset_rules()).select("doc_id", F.array_join("violations", ",").alias("violations"))


@register(
    "validation_rules",
    """WITH u AS (SELECT doc_id, text AS filename, n_chars - 200 AS file_size, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE ' ' || upper(md5(text)) END AS file_md5,
      doc_id % 4 AS chunk_size FROM documents),
    r AS (
      SELECT 'upload' AS kind, doc_id::VARCHAR AS id, [CASE WHEN NOT coalesce(length(filename), 0) BETWEEN 1 AND 255 THEN 'filename_length' END,
        CASE WHEN NOT coalesce(file_size >= 1, false) THEN 'size_positive' END, CASE WHEN doc_id % 3 = 0 OR file_md5 IS NULL THEN 'md5_format' END,
        CASE WHEN chunk_size < 1 THEN 'part_size_positive' END] AS v FROM u
      UNION ALL SELECT 'turn', conv_id || '-' || turn, [CASE WHEN turn < 1 THEN 'sequence_positive' END, CASE WHEN role = 'system' OR coalesce(text, '') = '' THEN 'query_empty' END] FROM conversations
      UNION ALL SELECT 'variant', event_id::VARCHAR, [CASE WHEN NOT coalesce(value BETWEEN 0 AND 1, false) THEN 'weight_range' END, CASE WHEN event_type = 'view' THEN 'query_empty' END] FROM events
      UNION ALL SELECT 'project', doc_id::VARCHAR, [CASE WHEN NOT coalesce(length(text), 0) BETWEEN 1 AND 120 THEN 'title_length' END] FROM documents)
    SELECT kind, id, array_to_string(list_filter(v, lambda x: x IS NOT NULL), ',') AS violations FROM r""",
)
def validation_rules(spark, sf):
    """Uploads, turns, query variants and projects against their rules."""
    docs = table(spark, sf, "documents")
    digest = F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.concat(F.lit(" "), F.upper(F.md5("text"))))
    uploads = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("filename"), (F.col("n_chars") - 200).alias("file_size"),
        digest.alias("file_md5"), (F.col("doc_id") % 4).alias("chunk_size"),
    )
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").alias("sequence_id"),
        F.when(F.col("role") != "system", F.col("text")).alias("user_query"),
    )
    variants = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("value").alias("weight"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("query"),
    )
    projects = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"))
    checked = {
        "upload": WS.validate(uploads, WS.upload_rules()), "turn": WS.validate(turns, WS.turn_rules()),
        "variant": WS.validate(variants, WS.variant_rules()), "project": WS.validate(projects, WS.project_rules()),
    }
    parts = [rows.select(F.lit(kind).alias("kind"), "id", F.array_join("violations", ",").alias("violations")) for kind, rows in checked.items()]
    return reduce(DataFrame.unionByName, parts)


# --- uploads: an order is an upload, a line is a part -------------------------------------


def upload_tables(spark, sf):
    """Eight-byte parts; an order has total parts by its key, its lines are the parts that arrived."""
    uploads = table(spark, sf, "orders").select(
        F.md5(F.col("o_orderkey").cast("string")).alias("upload_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("file_md5"),
        F.col("o_orderkey").cast("string").alias("filename"),
        (F.lit(8) * (F.col("o_orderkey") % 7) + 3).alias("file_size"),
        F.lit(8).alias("chunk_size"),
    )
    parts = table(spark, sf, "lineitem").select(
        F.md5(F.col("l_orderkey").cast("string")).alias("upload_id"),
        (F.col("l_linenumber") - 1).alias("part_index"),
        F.when(F.col("l_linenumber") == F.col("l_orderkey") % 7 + 1, 3).otherwise(8).cast("bigint").alias("n_bytes"),
    )
    return U.register_uploads(uploads), parts


_UPLOADS = """u AS (SELECT md5(o_orderkey::VARCHAR) AS upload_id, (o_orderkey % 7 + 1)::BIGINT AS total FROM orders),
    p AS (SELECT DISTINCT md5(l_orderkey::VARCHAR) AS upload_id, (l_linenumber - 1)::BIGINT AS part_index, l_orderkey % 7 + 1 AS total FROM lineitem WHERE l_linenumber <= l_orderkey % 7 + 1)"""


@register(
    "upload_completeness",
    f"""WITH {_UPLOADS}, r AS (SELECT upload_id, list(part_index ORDER BY part_index) AS received FROM p GROUP BY upload_id)
    SELECT upload_id, total AS total_chunks, coalesce(len(received), 0) AS uploaded_count, coalesce(len(received), 0) = total AS complete,
      array_to_string(list_filter(range(total), lambda i: received IS NULL OR NOT list_contains(received, i)), ',') AS missing
    FROM u LEFT JOIN r USING (upload_id)""",
)
def upload_completeness(spark, sf):
    uploads, parts = upload_tables(spark, sf)
    status = U.completeness(parts, uploads)
    return status.select(
        "upload_id", F.col("total_chunks").cast("bigint").alias("total_chunks"), F.col("uploaded_count").cast("bigint").alias("uploaded_count"),
        "complete", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"),
    )


@register(
    "part_checks",
    """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN l_linenumber > l_orderkey % 7 + 1 THEN 'out_of_range' ELSE 'ok' END AS problem
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY problem""",
)
def part_checks(spark, sf):
    uploads, parts = upload_tables(spark, sf)
    return U.check_parts(parts, uploads).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@register(
    "upload_outcomes",
    f"""WITH {_UPLOADS}, r AS (SELECT upload_id, count(*) AS n FROM p GROUP BY upload_id),
    o AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS upload_id, o_orderstatus FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'already_finalized' WHEN coalesce(n, 0) < total THEN 'incomplete'
      WHEN o_orderkey % 5 = 0 THEN 'md5_mismatch' ELSE 'finalized' END AS outcome FROM o JOIN u USING (upload_id) LEFT JOIN r USING (upload_id)""",
)
def upload_outcomes(spark, sf):
    uploads, parts = upload_tables(spark, sf)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    flags = orders.select(
        F.md5(F.col("o_orderkey").cast("string")).alias("upload_id"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "finalized").otherwise("uploading").alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("bad")).otherwise(F.md5(F.col("o_orderkey").cast("string"))).alias("merged_md5"),
    )
    status = U.completeness(parts, uploads).join(flags.select("upload_id", "o_orderkey", "status"), "upload_id")
    return U.finalize(status, flags.select("upload_id", "merged_md5")).select("o_orderkey", "outcome")


# --- splits and records ----------------------------------------------------------------------


@register(
    "stratified_split",
    """WITH c AS (SELECT quality::VARCHAR AS stratum, count(*) AS n FROM labels GROUP BY quality),
    e AS (SELECT stratum, n, least(n - 1, greatest(1, round_even(n * (1.0::DOUBLE - 0.8::DOUBLE), 0)::BIGINT)) AS ev FROM c)
    SELECT stratum, 'eval' AS split, ev AS n FROM e UNION ALL SELECT stratum, 'train', n - ev FROM e""",
)
def stratified_split(spark, sf):
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").cast("string").alias("stratum"))
    return A.stratified_split(cases, "stratum").groupBy("stratum", "split").agg(F.count("*").alias("n"))


def alignment_cases(spark, sf):
    """An event is a labelled tool case."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("case_id"), F.col("event_type").alias("category"), F.col("event_type").alias("user_query"),
        F.lit("t").alias("thought"), F.col("event_type").alias("action"), F.col("props").alias("arguments"),
        F.lit("final_answer").alias("rejected_action"), F.lit("{}").alias("rejected_arguments"), F.lit("r").alias("rejected_thought"),
    )


@register(
    "alignment_records",
    """SELECT event_id AS id, 'Q: ' || event_type AS prompt,
      '{"thought":"t","action":"' || event_type || '","arguments":' || props || '}' AS chosen,
      '{"thought":"r","action":"final_answer","arguments":{}}' AS rejected,
      '{"action":"' || event_type || '","arguments":' || props || '}' AS expected FROM events""",
)
def alignment_records(spark, sf):
    rows = A.dpo_records(alignment_cases(spark, sf).withColumn("split", F.lit("train")), F.concat(F.lit("Q: "), F.col("user_query")))
    return rows.select("id", "prompt", "chosen", "rejected", "expected")


_SPLIT = """n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n,
      row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS place FROM events),
    s AS (SELECT *, CASE WHEN place <= least(n - 1, greatest(1, round_even(n * (1.0::DOUBLE - 0.8::DOUBLE), 0)::BIGINT)) THEN 'eval' ELSE 'train' END AS split FROM n)"""


@register(
    "sft_records",
    f"""WITH {_SPLIT}, r AS (SELECT *, 'Pick.' || chr(10) || chr(10) || '可用工具目录：' || chr(10) || 'view, click' || chr(10) || chr(10) || '输出 JSON schema：' || chr(10) ||
        '{{"thought":"简短思考","action":"工具名或 final_answer","arguments":{{"参数名":"参数值"}}}}' || chr(10) || chr(10) || '决策规则：' || chr(10) || 'One tool.' || chr(10) || chr(10) ||
        '用户问题：' || event_type || chr(10) || chr(10) || '只返回 JSON：' AS prompt,
      '{{"thought":"t","action":"' || event_type || '","arguments":' || props || '}}' AS completion FROM s)
    SELECT event_id AS id, split, event_type AS category, prompt, completion, prompt || completion AS text,
      'user:' || prompt || '|assistant:' || completion AS messages, '{{"action":"' || event_type || '","arguments":' || props || '}}' AS expected FROM r""",
)
def sft_records(spark, sf):
    """Supervised records of split cases, with the decision prompt."""
    prompt = D.decision_prompt(F.lit("Pick."), F.lit("view, click"), F.lit("One tool."), F.col("user_query"))
    rows = A.sft_records(A.stratified_split(alignment_cases(spark, sf)), prompt)
    messages = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return rows.withColumn("messages", F.array_join(messages, "|"))


@register(
    "alignment_sets",
    f"""WITH {_SPLIT}, k AS (SELECT unnest(['sft', 'dpo']) AS kind) SELECT kind, split, event_id AS id, md5('Q: ' || event_type) AS prompt_md5 FROM s, k""",
)
def alignment_sets(spark, sf):
    """The written record files of both kinds and splits, read back."""
    out = f"{checkpoint_root(spark).rstrip('/')}/inkwell/alignment-{uuid.uuid4().hex}"
    jobs.build_alignment_sets(alignment_cases(spark, sf), F.concat(F.lit("Q: "), F.col("user_query")), out)
    parts = [
        ingest.read_jsonl(spark, f"{out}/{kind}_{split}", "id bigint, prompt string").select(
            F.lit(kind).alias("kind"), F.lit(split).alias("split"), "id", F.md5("prompt").alias("prompt_md5")
        )
        for kind in ("sft", "dpo") for split in ("train", "eval")
    ]
    return reduce(DataFrame.unionByName, parts)


# --- text functions ------------------------------------------------------------------------------


@register(
    "text_functions",
    f"""SELECT doc_id, {S.slug('text')} AS anchor, {S.key_slug('text')} AS key,
      {S.compact('text', 240)} AS compact, {S.compact_named('text', 80)} AS named FROM documents""",
)
def text_functions(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.slug(text).alias("anchor"), T.key_slug(text).alias("key"), T.compact(text, 240).alias("compact"),
        T.compact_named(text, 80).alias("named"),
    )


@register(
    "point_ids",
    """SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
      substring('89ab89ab89ab89ab', instr('0123456789abcdef', substring(h, 17, 1)), 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id
    FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || '-child-00001')) AS h FROM documents)""",
)
def point_ids(spark, sf):
    chunk = F.concat(F.col("doc_id").cast("string"), F.lit("-child-00001"))
    return table(spark, sf, "documents").select("doc_id", T.point_id(chunk).alias("point_id"))


@register(
    "tool_result_text",
    f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || ' ' || event_type WHEN event_id % 4 = 1 THEN event_type
      WHEN event_id % 4 = 2 THEN '["' || event_type || '"]' ELSE '{{"raw":"' || event_type || '"}}' END AS text FROM events""",
)
def tool_result_text(spark, sf):
    kind = F.col("event_type")
    quoted = F.concat(F.lit('"'), kind, F.lit('"'))
    payload = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"content":[{"text":'), quoted, F.lit('},{"text":'), quoted, F.lit("}]}")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"contents":[{"blob":'), quoted, F.lit("}]}")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"messages":['), quoted, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"raw":'), quoted, F.lit("}")))
    )
    return table(spark, sf, "events").select("event_id", V.summarize_tool_result(payload).alias("text"))


@register(
    "search_results",
    """WITH r AS (SELECT event_id, event_type, value FROM events)
    SELECT event_id AS run_id, 1 AS n, event_type AS title, 'abstract ' || event_type AS snippet, 1.0::DOUBLE AS score FROM r WHERE event_id % 2 = 0
    UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END, 'http://a/' || event_id, 'topic & one', CASE WHEN event_id % 2 = 0 THEN 0.82 ELSE 0.9 END FROM r
    UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END, event_type, 'nested', CASE WHEN event_id % 2 = 0 THEN 0.74 ELSE 0.82 END FROM r""",
)
def search_results(spark, sf):
    topics = F.concat(
        F.lit('"RelatedTopics":[{"Text":"topic  & one","FirstURL":"http://a/'), F.col("event_id").cast("string"),
        F.lit('"},{"Topics":[{"Text":"nested","FirstURL":""},{"Text":" "}]}]}'),
    )
    head = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"AbstractText":"abstract '), "event_type", F.lit('",'))).otherwise(F.lit("{"))
    payloads = table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("query"), F.concat(head, topics).alias("payload")
    )
    return V.search_result_rows(payloads).select("run_id", F.col("n").cast("bigint").alias("n"), "title", "snippet", "score")
