"""SQL fragments shared by the DuckDB counterparts."""

from __future__ import annotations

from inkwell.functions import text as T


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = quoted(T.WHITESPACE)
WS_RUN = quoted(T.WS_CLASS + "+")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {WS_RUN}, ' ', 'g'), ' ')"


def compact(x: str, limit: int) -> str:
    return f"substring({collapse(x)}, 1, {limit})"


def compact_named(x: str, limit: int) -> str:
    cut = strip(compact(x, limit))
    return f"(CASE WHEN {cut} = '' THEN '{T.UNNAMED}' ELSE {cut} END)"


def tokens(x: str) -> str:
    return (
        f"list_distinct(list_concat(regexp_extract_all({x}, {quoted(T.CJK_RUN)}), "
        f"regexp_extract_all(lower({x}), {quoted(T.LATIN_TOKEN)})))"
    )


def fallback_tokens(x: str) -> str:
    text = f"lower({strip(x)})"
    return (
        f"(CASE WHEN len({tokens(x)}) > 0 THEN {tokens(x)} "
        f"WHEN {text} = '' THEN ['{T.EMPTY_TOKEN}'] ELSE [{text}] END)"
    )


def token_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(T.ROUGH_TOKEN)}))"


def contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(t)})" for t in terms) + ")"


def search_ctes(chunks: str, queries: str) -> str:
    """CTEs up to ``pairs(query_id, chunk_id, pos, overlap, bm25)``.

    ``chunks`` selects ``chunk_id, pos, content``; ``queries`` selects ``query_id, query``.
    """
    return f"""
    chunk_in AS ({chunks}),
    query_in AS ({queries}),
    corpus AS (
      SELECT chunk_id, pos, {fallback_tokens('content')} AS tokens, len({tokens('content')}) > 0 AS has_tokens
      FROM chunk_in),
    terms AS (
      SELECT query_id, len({tokens('query')}) > 0 AS query_has_tokens, unnest({fallback_tokens('query')}) AS token
      FROM query_in),
    totals AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM corpus),
    postings AS (SELECT chunk_id, pos, has_tokens, len(tokens) AS doc_len, unnest(tokens) AS token FROM corpus),
    raw_idf AS (
      SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r
      FROM postings, totals GROUP BY token),
    idf AS (
      SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw_idf) ELSE r END AS idf FROM raw_idf),
    pairs AS (
      SELECT query_id, chunk_id, pos,
             count(*) FILTER (WHERE has_tokens AND query_has_tokens)::DOUBLE AS overlap,
             round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS bm25
      FROM terms JOIN idf USING (token) JOIN postings USING (token), totals
      GROUP BY query_id, chunk_id, pos)"""


def top_k(score: str, k: int, source: str = "pairs") -> str:
    return f"""SELECT * FROM (
      SELECT query_id, chunk_id, pos, {score} AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, pos, chunk_id) AS rank
      FROM {source} WHERE {score} > 0) WHERE rank <= {k}"""


def fusion_ctes(k: int) -> str:
    """CTEs from ``dense`` and ``sparse`` ranked lists to ``fused``."""
    return f"""
    lists AS (
      SELECT query_id, chunk_id, coalesce(d.pos, s.pos) AS pos, d.rank AS dense_rank, s.rank AS sparse_rank,
             coalesce(d.score, 0.0) AS dense_score, coalesce(s.score, 0.0) AS sparse_score
      FROM dense d FULL OUTER JOIN sparse s USING (query_id, chunk_id)),
    fusion AS (
      SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9)
             AS fusion_score FROM lists),
    fused AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, dense_score DESC,
                  sparse_score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, chunk_id) AS fusion_rank
        FROM fusion) WHERE fusion_rank <= {k})"""


def reranked(limit: int, source: str = "fused") -> str:
    return f"""SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id
                ORDER BY score DESC, fusion_score DESC, fusion_rank) AS rank
      FROM (SELECT *, round(fusion_score + dense_score + sparse_score, 9) AS score FROM {source}))
      WHERE rank <= {limit}"""


def key_slug(x: str, limit: int = 48) -> str:
    raw = f"trim(regexp_replace(lower({strip(x)}), '[^a-zA-Z0-9一-鿿]+', '_', 'g'), '_')"
    return f"substring(CASE WHEN {raw} = '' THEN 'item' ELSE {raw} END, 1, {limit})"


def slug(x: str, limit: int = 72, default: str = "chunk") -> str:
    raw = f"substring(trim(regexp_replace(lower({strip(x)}), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '-'), 1, {limit})"
    return f"(CASE WHEN {raw} = '' THEN '{default}' ELSE {raw} END)"


def short_sentences(x: str, limit: int = 3) -> str:
    parts = f"list_transform(regexp_split_to_array({x}, '[。\n!?；;]+'), lambda p: {strip('p')})"
    return f"list_slice(list_filter({parts}, lambda p: p <> ''), 1, {limit})"
