"""From weighted searches to labelled evidence with parent context."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import rewrite as W
from inkwell.functions import text as T
from inkwell.operators import retrieval as R
from inkwell.session import materialized, within_rows

LOOKUP_THRESHOLD = 0.28
GENERAL_THRESHOLD = 0.18


def merge_searches(hits: DataFrame, limit: int) -> DataFrame:
    """One list per query from the hits of its weighted searches.

    ``hits(query_id, query_no, weight, matched_query, chunk_id, rank, score)``.
    A chunk keeps its best boosted score, the earliest search on ties, and the
    place of its first appearance for the final order.
    """
    boosted = F.round(
        F.col("score") * F.greatest(F.col("weight"), F.lit(0.05)) + 0.02 / F.col("query_no") + 0.01 / F.col("rank"),
        R.SCORE_DIGITS,
    )
    best = (
        hits.withColumn("boosted", boosted)
        .groupBy("query_id", "chunk_id")
        .agg(
            F.max_by("matched_query", F.struct("boosted", -F.col("query_no"), -F.col("rank"))).alias("matched_query"),
            F.max("boosted").alias("score"),
            F.min(F.struct("query_no", "rank")).alias("first_seen"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first_seen"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("first_seen")


def centered_context(parent: Column, child: Column, limit: int) -> Column:
    """Parent text cut to ``limit`` characters around the child, with dots at cut ends."""
    whole, part = T.collapse_spaces(parent), T.collapse_spaces(child)
    length = F.length(whole)
    probe = F.substring(part, 1, 160)
    at = T.find(whole, probe)
    end = F.least(F.greatest(at - limit // 3, F.lit(0)) + limit, length)
    start = F.greatest(end - limit, F.lit(0))
    cut = F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
        T.strip(whole.substr(start + 1, end - start)),
        F.when(end < length, F.lit("...")).otherwise(F.lit("")),
    )
    return F.when(length <= limit, whole).when(at < 0, T.strip(F.substring(whole, 1, limit))).otherwise(cut)


def with_parent_context(hits: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds payload, parent title and context to few hits; a missing parent keeps the child text.

    Hits are ``limit`` rows per query: when a count shows that they are few,
    they are broadcast to the chunk scan and no chunk is shuffled.
    """
    wanted = hits.select("chunk_id").distinct()
    small = within_rows(hits, settings.broadcast_max_rows)

    def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(ids) if small else ids, "chunk_id", "left_semi")

    children = only(
        chunks.select("chunk_id", "asset_id", "title", "asset_type", "content", "source_path", "parent_id"), wanted
    )
    parents = only(
        chunks.where(F.col("chunk_level") == "parent").select("chunk_id", "title", "content", "source_path"),
        children.select(F.col("parent_id").alias("chunk_id")).distinct(),
    ).select(
        F.col("chunk_id").alias("parent_id"),
        F.col("title").alias("parent_title"),
        F.col("content").alias("parent_content"),
        F.col("source_path").alias("parent_source_path"),
    )
    found = hits.join(children, "chunk_id").join(parents, "parent_id", "left")
    context = centered_context(F.col("parent_content"), F.col("content"), settings.snippet_chars)
    return found.withColumn("context", F.coalesce(context, F.col("content")))


def label(rank: Column) -> Column:
    return F.concat(F.lit("C"), rank.cast("string"))


def evidence_rows(expanded: DataFrame) -> DataFrame:
    """Labelled evidence rows with tags, as they are shown and stored."""
    return expanded.select(
        "query_id",
        label(F.col("rank")).alias("label"),
        "rank",
        "asset_id",
        "chunk_id",
        F.when(F.coalesce("parent_title", F.lit("")) != "", F.col("parent_title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("context") != "", F.col("context")).otherwise(F.col("content")).alias("snippet"),
        F.coalesce(F.nullif(F.col("parent_source_path"), F.lit("")), F.col("source_path")).alias("source_path"),
        F.round("score", 4).alias("score"),
        F.array(
            F.col("asset_type"), F.lit("plan"), F.lit("hybrid"), F.lit("child-reranked"), F.lit("parent-context"),
            T.compact_named(F.col("matched_query"), 48),
        ).alias("tags"),
    )


def weighted_searches(searches: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS, index: R.SearchIndex | None = None) -> DataFrame:
    """Hybrid hits of every search ``query_id, query_no, query, weight`` in one pass over the corpus.

    Equal search texts are scored once, whoever asks them.
    """
    # A digest of the text keeps the scoring keys short.
    digest = F.unhex(F.md5("query"))
    texts = searches.select(digest.alias("query_id"), "query").distinct()
    hits = R.hybrid_search(texts, chunks, settings.retrieval_limit, settings=settings, index=index)
    flat = hits.select(F.col("query_id").alias("text_id"), "chunk_id", "rank", "score")
    asked = searches.select("query_id", "query_no", "weight", "query", digest.alias("text_id"))
    return asked.join(flat, "text_id").drop("text_id").withColumnRenamed("query", "matched_query")


def retrieve(
    searches: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS, index: R.SearchIndex | None = None
) -> DataFrame:
    """Evidence rows per query for weighted searches over two-level chunks."""
    hits = weighted_searches(searches, chunks, settings, index)
    # At most ``limit`` rows per query: written once, so that neither the count nor the payload joins repeat the search.
    merged = materialized(merge_searches(hits, settings.retrieval_limit), "merged-hits")
    return evidence_rows(with_parent_context(merged, chunks, settings))


def strength(evidence: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``query_id, n_hits, top_score, strength`` of non-empty evidence lists."""
    return evidence.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.max_by("score", -F.col("rank")).alias("top_score")
    ).withColumn(
        "strength",
        F.round(F.col("top_score") + 0.05 * F.least(F.col("n_hits"), F.lit(settings.retrieval_limit)), R.SCORE_DIGITS),
    )


def weak_queries(queries: DataFrame, evidence: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Queries whose first retrieval is empty or below the threshold of their kind."""
    threshold = F.when(W.is_lookup(F.col("query")), F.lit(LOOKUP_THRESHOLD)).otherwise(F.lit(GENERAL_THRESHOLD))
    top = strength(evidence, settings)
    judged = queries.join(top, "query_id", "left")
    return judged.where(F.col("top_score").isNull() | (F.col("top_score") < threshold)).select(*queries.columns)


def retrieve_with_replan(
    queries: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS, index: R.SearchIndex | None = None
) -> DataFrame:
    """Evidence with a second, broadened pass for weak queries; the stronger pass stays, ties go to the retry.

    Adds ``replanned`` (a second pass ran) and ``from_retry`` (its rows won).
    """
    index = R.temporary_index(chunks) if index is None else index
    # Evidence is a few rows per query, but every later step reads it: write it once.
    first = materialized(retrieve(W.rewrite_queries(queries, settings), chunks, settings, index), "first-pass")
    weak = materialized(weak_queries(queries, first, settings), "weak-queries")
    if weak.isEmpty():
        return first.select("*", F.lit(False).alias("replanned"), F.lit(False).alias("from_retry"))
    retry = materialized(retrieve(W.rewrite_queries(weak, settings, broaden=True), chunks, settings, index), "retry")
    return stronger_pass(weak, first, retry, settings)


def stronger_pass(weak: DataFrame, first: DataFrame, retry: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of the first pass, or of the retry for those weak queries where it is at least as strong; an empty pass has strength 0."""
    before = strength(first, settings).select("query_id", F.col("strength").alias("before"))
    after = strength(retry, settings).select("query_id", F.col("strength").alias("after"))
    verdict = (
        weak.select("query_id").join(before, "query_id", "left").join(after, "query_id", "left")
        .select("query_id", (F.coalesce("after", F.lit(0.0)) >= F.coalesce("before", F.lit(0.0))).alias("retry_wins"))
    )
    kept = first.join(verdict, "query_id", "left").where(~F.coalesce("retry_wins", F.lit(False))).select(
        *first.columns, F.col("retry_wins").isNotNull().alias("replanned"), F.lit(False).alias("from_retry")
    )
    won = retry.join(verdict.where("retry_wins"), "query_id").select(
        *retry.columns, F.lit(True).alias("replanned"), F.lit(True).alias("from_retry")
    )
    return kept.unionByName(won)


def relabel(evidence: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Labels over appended evidence lists: position over (step, place)."""
    w = Window.partitionBy(group).orderBy(*order)
    return evidence.withColumn("label", label(F.row_number().over(w)))


def citations(evidence: DataFrame) -> DataFrame:
    return evidence.select("query_id", "asset_id", "chunk_id", "label", "score")


def observation_evidence(observations: DataFrame) -> DataFrame:
    """Evidence from recorded tool results: ``run_id, step_id, server, capability_type, name, content, project_id``."""
    numbered = F.row_number().over(Window.partitionBy("run_id").orderBy("step_no"))
    kind, name = F.col("capability_type"), F.col("name")
    return observations.withColumn("n", numbered).select(
        "run_id",
        F.concat(F.lit("mcp:"), "server").alias("asset_id"),
        F.concat_ws(":", "step_id", kind, name).alias("chunk_id"),
        label(F.col("n")).alias("label"),
        F.concat(F.col("server"), F.lit("."), kind, F.lit(":"), name).alias("title"),
        F.substring("content", 1, 320).alias("snippet"),
        F.concat(F.lit("mcp://"), F.concat_ws("/", "server", kind, name)).alias("source_path"),
        F.lit(1.0).alias("score"),
        F.array(F.lit("mcp"), F.col("server"), kind, F.col("project_id")).alias("tags"),
    )


def live_evidence(results: DataFrame, tags: Column) -> DataFrame:
    """Evidence rows of live results ``run_id, n, title, snippet, source_path, score``."""
    return results.select(
        "run_id",
        F.lit("live-tool").alias("asset_id"),
        F.concat(F.lit("live-"), F.col("n").cast("string"), F.lit("-"), T.slug(F.col("title"), 48)).alias("chunk_id"),
        label(F.col("n")).alias("label"),
        "title",
        F.substring("snippet", 1, 320).alias("snippet"),
        "source_path",
        F.round("score", 4).alias("score"),
        tags.alias("tags"),
    )


def _leaf_topics(payload: str | None) -> list[tuple[str | None, str | None]]:
    """Text and address of the topics without subtopics, at any depth, in reply order; none for malformed replies."""
    try:
        reply = json.loads(payload or "null")
    except ValueError:
        return []

    def children(x, key):
        found = x.get(key) if isinstance(x, dict) else None
        return found[::-1] if isinstance(found, list) else None

    def string(x):
        return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    waiting, leaves = children(reply, "RelatedTopics") or [], []
    while waiting:
        topic = waiting.pop()
        below = children(topic, "Topics")
        if below is not None:
            waiting += below
        elif isinstance(topic, dict):
            leaves.append((string(topic.get("Text")), string(topic.get("FirstURL"))))
    return leaves


def search_result_rows(payloads: DataFrame) -> DataFrame:
    """Rows of a recorded search reply ``run_id, query, payload``: abstract, then topics of any depth, five at most."""
    parsed = payloads.withColumn("p", F.from_json("payload", "AbstractText string, AbstractURL string, Heading string"))
    topics = F.udf(_leaf_topics, "array<struct<Text:string,FirstURL:string>>", useArrow=True)(F.col("payload"))
    heading = F.coalesce(F.nullif(F.col("p.Heading"), F.lit("")), F.col("query"))
    search_url = F.concat(F.lit("https://duckduckgo.com/?q="), F.url_encode("query"))
    first_text = T.collapse_spaces(F.coalesce("p.AbstractText", F.lit("")))
    abstract = F.when(
        first_text != "",
        F.struct(
            heading.alias("title"), first_text.alias("snippet"),
            F.coalesce(F.nullif(F.col("p.AbstractURL"), F.lit("")), search_url).alias("source_path"),
            F.lit("abstract").alias("kind"),
        ),
    )
    related = F.transform(
        F.filter(topics, lambda t: T.collapse_spaces(F.coalesce(t["Text"], F.lit(""))) != ""),
        lambda t: F.struct(
            F.coalesce(F.nullif(t["FirstURL"], F.lit("")), heading).alias("title"),
            T.collapse_spaces(t["Text"]).alias("snippet"),
            F.coalesce(F.nullif(t["FirstURL"], F.lit("")), search_url).alias("source_path"),
            F.lit("related").alias("kind"),
        ),
    )
    rows = F.slice(F.array_compact(F.concat(F.array(abstract), related)), 1, 5)
    flat = parsed.select("run_id", F.posexplode_outer(rows).alias("at", "r")).where("r is not null").select("run_id", "at", "r.*")
    score = F.when(F.col("kind") == "abstract", F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.45), F.round(F.lit(0.9) - F.col("at") * 0.08, 4))
    )
    return flat.select("run_id", (F.col("at") + 1).alias("n"), "title", "snippet", "source_path", score.alias("score"), "kind")


def summarize_tool_result(payload: Column, limit: int = 3000) -> Column:
    """Readable text of a recorded tool reply: content parts, resource contents, messages or the whole reply."""
    content = F.from_json(payload, "content array<struct<text:string,resource:string>>")["content"]
    raw_parts = F.from_json(payload, "content array<string>")["content"]
    parts = F.zip_with(
        content, raw_parts,
        lambda c, raw: F.coalesce(c["text"], T.compact_named(c["resource"], 800), T.compact_named(raw, 800)),
    )
    contents = F.from_json(payload, "contents array<struct<text:string,blob:string>>")["contents"]
    raw_contents = F.from_json(payload, "contents array<string>")["contents"]
    blobs = F.zip_with(
        contents, raw_contents,
        lambda c, raw: F.coalesce(F.nullif(c["text"], F.lit("")), F.nullif(c["blob"], F.lit("")), T.compact_named(raw, 800)),
    )
    messages = F.get_json_object(payload, "$.messages")
    options = [
        F.when(F.size(parts) > 0, F.array_join(parts, "\n")),
        F.when(F.size(blobs) > 0, F.array_join(blobs, "\n")),
        F.when(F.startswith(messages, F.lit("[")), messages),
        payload,
    ]
    return T.compact_named(reduce(lambda a, b: F.coalesce(a, b), options), limit)
