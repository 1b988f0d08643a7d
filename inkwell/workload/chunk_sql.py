"""DuckDB counterpart of sentences and two-level chunks, for texts without headings and page marks.

Packing is a recursive query with one step per item: it closes a group where the next item would pass the budget or the
owner changes, and finds the start of the overlap with prefix sums.
"""

from __future__ import annotations

from inkwell.config import DEFAULTS
from inkwell.functions import text as T
from inkwell.operators import chunking as C
from inkwell.workload import sqltext as S

#: A sentence without look-around: a shortest run up to enders, up to a blank after ``. ! ?``, or to the end.
SENTENCE = S.quoted(f"(?s).*?(?:.[{C.ENDERS}]+|[.!?]{T.WS_CLASS}+|." + r"\z)")


def rough(x: str) -> str:
    return f"regexp_extract_all({x}, {S.quoted(T.ROUGH_TOKEN)})"


SENTENCES = f"""flat_texts AS (
      SELECT doc_id, replace(regexp_replace(array_to_string(list_transform(string_split({S.strip("regexp_replace(text, '\r\n?', '\n', 'g')")}, chr(10)),
        lambda l: {S.strip('l')}), chr(10)), '\n\n+', chr(29), 'g'), chr(10), ' ') AS flat FROM documents),
    sentence_lists AS (
      SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(flat, chr(29)), lambda p: regexp_extract_all(p, {SENTENCE}))),
        lambda s: {S.strip('s')}), lambda s: s <> '') AS texts FROM flat_texts),
    sentences AS (SELECT doc_id, unnest(texts) AS text, generate_subscripts(texts, 1) - 1 AS "at" FROM sentence_lists)"""


def cut(source: str, budget: int, name: str, key: str) -> str:
    """Items of at most ``budget`` tokens; ``key`` orders the rows of a document in ``source``."""
    tokens, many = rough("text"), f"len({rough('text')})"
    return f"""{name} AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS n, owner, text, len({tokens}) AS size FROM (
        SELECT doc_id, k, owner, unnest(parts) AS text, generate_subscripts(parts, 1) AS j FROM (
          SELECT doc_id, {key} AS k, owner, CASE WHEN {many} > {budget} THEN list_transform(range(0, {many}, {budget}),
            lambda i: array_to_string({tokens}[i + 1:i + {budget}], ' ')) ELSE [text] END AS parts FROM {source})))"""


def pack(items: str, budget: int, overlap: int, name: str) -> str:
    """``doc_id, number, owner, first, last, text, size`` of the groups over ``items``."""
    return f"""{name}_lists AS (
      SELECT doc_id, list(size ORDER BY n) AS sizes, list(owner ORDER BY n) AS owners, list(text ORDER BY n) AS texts,
        list_concat([0], list(upto ORDER BY n)) AS sums
      FROM (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS upto FROM {items}) GROUP BY doc_id),
    {name}_fold AS (
      SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS first, NULL::BIGINT AS closed FROM {name}_lists
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN owners[i + 2] <> owners[i + 1] THEN i + 1
          WHEN sums[i + 3] - sums[first + 1] > {budget} THEN
            CASE WHEN {overlap} = 0 THEN i + 1 ELSE coalesce(list_filter(range(first, i + 1), lambda f: sums[i + 2] - sums[f + 1] <= {overlap})[1], i) END
          ELSE first END,
        CASE WHEN owners[i + 2] <> owners[i + 1] OR sums[i + 3] - sums[first + 1] > {budget} THEN first END
      FROM {name}_fold JOIN {name}_lists USING (doc_id) WHERE i + 1 < len(sizes)),
    {name} AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY last) AS number, owners[first + 1] AS owner, first, last,
        {S.strip("array_to_string(texts[first + 1:last + 1], ' ')")} AS text, sums[last + 2] - sums[first + 1] AS size
      FROM (SELECT doc_id, closed AS first, i - 1 AS last FROM {name}_fold WHERE closed IS NOT NULL
        UNION ALL SELECT doc_id, arg_max(first, i), max(i) FROM {name}_fold GROUP BY doc_id) JOIN {name}_lists USING (doc_id))"""


_SPAN_TOKENS, _PIECE_TOKENS = max(DEFAULTS.parent_tokens, C.MIN_BUDGET), max(DEFAULTS.child_tokens, C.MIN_BUDGET)
CHUNKS = f"""{SENTENCES},
    {cut('(SELECT *, 0 AS owner FROM sentences)', _SPAN_TOKENS, 'spans', '"at"')},
    {pack('spans', _SPAN_TOKENS, 0, 'parents')},
    {cut('(SELECT s.doc_id, s.n, s.text, p.number AS owner FROM spans s JOIN parents p ON p.doc_id = s.doc_id AND s.n BETWEEN p.first AND p.last)',
         _PIECE_TOKENS, 'pieces', 'n')},
    {pack('pieces', _PIECE_TOKENS, min(DEFAULTS.child_overlap_tokens, _PIECE_TOKENS // 2), 'children')},
    chunk_rows AS (
      SELECT doc_id, 'parent' AS chunk_level, number, '' AS parent_id, text, size FROM parents
      UNION ALL SELECT doc_id, 'child', number, doc_id || '-parent-' || printf('%05d', owner), text, size FROM children),
    chunks AS (
      SELECT c.*, doc_id || '-' || chunk_level || '-' || printf('%05d', number) AS chunk_id, 'document ' || doc_id AS title, lang, source AS asset_type,
        '/assets/' || doc_id AS source_path FROM chunk_rows c JOIN documents USING (doc_id))"""
