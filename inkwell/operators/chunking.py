"""Sections, sentences and two-level chunks.

Arrays become rows with the outer form of explode: the plain form adds a
not-empty filter that the optimizer pushes below the projections, which would
evaluate the whole text expression a second time.

Text stays in the JVM: sections, sentences, hard splits and token counts are
array expressions inside one row, so no shuffle moves document text. Only the
greedy packing, a sequential fold with overlap feedback, runs in a Python
worker, and it sees token counts, never text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import text as T

BODY_HEADING = "正文"
MIN_BUDGET = 32
HEADING = f"^(#{{1,6}}){T.WS_CLASS}+(.*)$"
PAGE_MARKER = f"^<!--{T.WS_CLASS}*page:([0-9]+){T.WS_CLASS}*-->$"
PATH_SEPARATOR = " / "
MARKER_START = "<!--"
# Line breaks other than \n; they are turned into \n first, which frees \x1d as an inner mark.
EXOTIC_BREAKS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
MARK = "\x1d"
ENDERS = "。！？!?；;"
# A sentence runs to a group of enders, to a blank after ``. ! ?``, to a mark or to the end.
# No end stands before an ASCII word character; this one test spares most places the four others.
SENTENCE = rf"[^{MARK}]+?(?!\w)" + f"(?:[{ENDERS}]+|(?<=[.!?]){T.WS_CLASS}+|(?={MARK})|" + r"\z)"


# --- sections -------------------------------------------------------------------


def _page_of(line: Column) -> Column:
    return F.regexp_extract(line, PAGE_MARKER, 1)


def _heading_paths(headings: Column) -> Column:
    """Path of each heading: the latest heading of every level not yet closed by a higher one."""

    def step(state, h):
        stack = F.transform(
            state["stack"],
            lambda old, i: F.when(i + 1 < h["level"], old).when(i + 1 == h["level"], h["title"]),
        )
        path = F.array_join(F.filter(stack, lambda s: s.isNotNull()), PATH_SEPARATOR)
        return F.struct(stack.alias("stack"), F.concat(state["paths"], F.array(path)).alias("paths"))

    start = F.struct(
        F.array_repeat(F.lit(None).cast("string"), 6).alias("stack"), T.no_strings().alias("paths")
    )
    return F.aggregate(headings, start, step, lambda s: s["paths"])


def _section_body(lines: Column, first: Column, after: Column) -> Column:
    return T.strip(F.array_join(F.slice(lines, first + 1, after - first), "\n"))


def _page_range(lines: Column, markers: Column, first: Column, after: Column) -> Column:
    """Pages of the non-empty lines in ``[first, after)``; the running page when there are none."""
    carried = F.filter(markers, lambda m: m["at"] < first)
    running = F.when(F.size(carried) > 0, F.element_at(carried, -1)["page"]).otherwise(F.lit(0))
    inside = F.filter(markers, lambda m: (m["at"] >= first) & (m["at"] < after))
    spans = F.concat(F.array(F.struct((first - 1).alias("at"), running.alias("page"))), inside)
    stops = F.concat(F.transform(inside, lambda m: m["at"]), F.array(after))
    with_text = F.filter(
        F.zip_with(spans, stops, lambda s, stop: F.struct(s["at"], s["page"], stop.alias("stop"))),
        lambda s: (s["page"] > 0)
        & F.exists(F.slice(lines, s["at"] + 2, s["stop"] - s["at"] - 1), lambda x: T.strip(x) != ""),
    )
    pages = F.transform(with_text, lambda s: s["page"])
    last = F.element_at(spans, -1)["page"]
    return F.when(F.size(pages) > 0, pages).otherwise(F.array(last))


def with_sections(docs: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``sections``: array of ``heading, body, page_start, page_end`` per document.

    Sections without body drop out; a document without any becomes one section
    with the default heading. Everything happens inside the row.
    """
    keep = docs.columns

    def heading(x, i):
        line = T.strip(x)
        return F.struct(
            i.alias("at"),
            F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
            T.strip(F.regexp_extract(line, HEADING, 2)).alias("title"),
        )

    def marker(x, i):
        return F.struct(i.alias("at"), _page_of(T.strip(x)).try_cast("int").alias("page"))

    # Most documents have neither headings nor page marks; two substring tests spare them the line scan.
    text = F.regexp_replace(T.normalize_newlines(F.col(content)), EXOTIC_BREAKS, "\n")
    flagged = docs.select(*keep, text.alias("_text")).withColumn(
        "_lines",
        F.when(
            F.contains("_text", F.lit("#")) | F.contains("_text", F.lit(MARKER_START)), F.split("_text", "\n")
        ).otherwise(F.array("_text")),
    )
    marked = flagged.select(
        "*",
        F.when(
            F.contains("_text", F.lit("#")), F.filter(F.transform("_lines", heading), lambda h: h["level"] > 0)
        ).otherwise(F.array().cast("array<struct<at:int,level:int,title:string>>")).alias("_headings"),
        F.when(
            F.contains("_text", F.lit(MARKER_START)),
            F.filter(F.transform("_lines", marker), lambda m: m["page"].isNotNull()),
        ).otherwise(F.array().cast("array<struct<at:int,page:int>>")).alias("_markers"),
    )
    found = marked.select(
        *keep,
        "_lines",
        "_markers",
        F.concat(
            F.array(F.struct(F.lit(0).alias("first"), F.lit(BODY_HEADING).alias("heading"))),
            F.zip_with(
                F.col("_headings"),
                _heading_paths(F.col("_headings")),
                lambda h, path: F.struct((h["at"] + 1).alias("first"), path.alias("heading")),
            ),
        ).alias("_starts"),
        F.concat(F.transform("_headings", lambda h: h["at"]), F.array(F.size("_lines"))).alias("_stops"),
    )

    def section(s, stop):
        pages = _page_range(F.col("_lines"), F.col("_markers"), s["first"], stop)
        return F.struct(
            s["heading"].alias("heading"),
            _section_body(F.col("_lines"), s["first"], stop).alias("body"),
            F.array_min(pages).alias("page_start"),
            F.array_max(pages).alias("page_end"),
        )

    cut = found.select(
        *keep,
        F.filter(F.zip_with("_starts", "_stops", section), lambda s: s["body"] != "").alias("_found"),
    )
    whole = F.array(
        F.struct(
            F.lit(BODY_HEADING).alias("heading"),
            T.strip(F.col(content)).alias("body"),
            F.lit(0).alias("page_start"),
            F.lit(0).alias("page_end"),
        )
    )
    return cut.select(*keep, F.when(F.size("_found") > 0, F.col("_found")).otherwise(whole).alias("sections"))


def section_rows(docs: DataFrame, content: str = "content") -> DataFrame:
    """One row per section: ``section_no`` from 1, ``heading, body, page_start, page_end``."""
    keep = [c for c in docs.columns if c != content]
    return with_sections(docs, content).select(*keep, F.posexplode_outer("sections").alias("_no", "_s")).select(
        *keep, (F.col("_no") + 1).alias("section_no"), "_s.*"
    )


# --- sentences --------------------------------------------------------------------


def _stripped_pieces(paragraph: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0)), T.strip)
    return F.filter(parts, lambda p: p != "")


def sentences(col: Column) -> Column:
    """Sentences of text whose paragraphs are separated by empty lines; lines are not joined."""
    text = F.translate(T.normalize_newlines(col), MARK, " ")
    return _stripped_pieces(F.regexp_replace(text, "\n\n", MARK))


def _sized(pieces: Column, page: Column) -> Column:
    return F.transform(
        pieces, lambda p: F.struct(p.alias("text"), page.alias("page"), T.token_count(p).alias("size"))
    )


def _plain_spans(body: Column) -> Column:
    """Empty lines become marks, other line ends blanks; one pattern then cuts all sentences."""
    lines = F.array_join(F.transform(F.split(body, "\n"), T.strip), "\n")
    flat = F.replace(F.regexp_replace(lines, "\n\n+", MARK), F.lit("\n"), F.lit(" "))
    return _sized(_stripped_pieces(flat), F.lit(0))


def _paged_spans(body: Column) -> Column:
    lines = F.transform(F.split(body, "\n"), T.strip)
    marked = F.transform(
        lines,
        lambda x: F.when(x == "", F.lit("\n"))
        .when(x.rlike(PAGE_MARKER), F.concat(F.lit("\n" + MARK), _page_of(x), F.lit("\n")))
        .otherwise(x),
    )
    blocks = F.filter(
        F.transform(F.split(F.array_join(marked, " "), "\n"), lambda b: F.btrim(b, F.lit(" "))), lambda b: b != ""
    )

    def step(state, b):
        is_page = F.startswith(b, F.lit(MARK))
        page = F.when(is_page, F.substring(b, 2, 20).try_cast("int")).otherwise(state["page"])
        fresh = F.when(is_page, F.slice(state["spans"], 1, 0)).otherwise(_sized(_stripped_pieces(b), state["page"]))
        return F.struct(page.alias("page"), F.concat(state["spans"], fresh).alias("spans"))

    start = F.struct(
        F.lit(0).alias("page"), F.array().cast("array<struct<text:string,page:int,size:int>>").alias("spans")
    )
    return F.aggregate(blocks, start, step, lambda s: s["spans"])


def sentence_spans(body: Column) -> Column:
    """Array of ``text, page, size``. Empty lines and page marks end a paragraph, lines join with a blank."""
    text = F.regexp_replace(T.normalize_newlines(body), EXOTIC_BREAKS, "\n")
    return F.when(F.contains(body, F.lit(MARKER_START)), _paged_spans(text)).otherwise(_plain_spans(text))


def hard_split(span: Column, budget: int) -> Column:
    """A sized span over the budget is cut every ``budget`` tokens; tokens join with blanks."""
    budget = max(budget, MIN_BUDGET)

    def cut(tokens: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), span["size"] - 1, F.lit(budget)),
            lambda i: F.struct(
                F.array_join(F.slice(tokens, i + 1, F.lit(budget)), " ").alias("text"),
                span["page"].alias("page"),
                F.least(F.lit(budget), span["size"] - i).alias("size"),
            ),
        )

    # Bound: inside the inner function the whole span would be cut into tokens again for each of its parts.
    parts = T.bound(T.rough_tokens(span["text"]), cut)
    whole = F.struct(span["text"].alias("text"), span["page"].alias("page"), span["size"].alias("size"))
    return F.when(span["size"] > budget, parts).otherwise(F.array(whole))


# --- packing -----------------------------------------------------------------------


def pack_sizes(owners, sizes, budget: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Greedy groups of neighbouring items as inclusive ``(first, last)`` index pairs.

    A group closes when its owner changes or when the next item would pass the
    budget. After a full group, the next one starts with the longest tail that
    fits the overlap, at least one item; the tail is not checked against the
    budget again.
    """
    budget = max(budget, MIN_BUDGET)
    overlap = max(0, min(overlap, budget // 2))
    groups, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i and owners[i] != owners[i - 1]:
            groups.append((first, i - 1))
            first, total = i, 0
        elif i > first and total + size > budget:
            groups.append((first, i - 1))
            floor, first, total = first, i, 0
            if overlap:
                first, total = i - 1, sizes[i - 1]
                while first > floor and total + sizes[first - 1] <= overlap:
                    first -= 1
                    total += sizes[first]
        total += size
    if len(sizes):
        groups.append((first, len(sizes) - 1))
    return groups


def two_level_packer(settings: Settings):
    """Arrow UDF: parent groups over spans and child groups over their pieces, in one pass.

    It receives, per document, the owner section and size of every span, the
    number of child pieces of every span, and all piece sizes. Text never
    reaches the worker.
    """
    parent_budget, child_budget, overlap = (
        settings.parent_tokens,
        settings.child_tokens,
        settings.child_overlap_tokens,
    )

    def one(owners, sizes, piece_counts, piece_sizes):
        parents = pack_sizes(owners, sizes, parent_budget)
        owner_of_piece = []
        for number, (first, last) in enumerate(parents):
            owner_of_piece.extend([number] * sum(piece_counts[first : last + 1]))
        children = pack_sizes(owner_of_piece, piece_sizes, child_budget, overlap)
        return {
            "parents": [{"first": a, "last": b} for a, b in parents],
            "children": [{"parent": owner_of_piece[a], "first": a, "last": b} for a, b in children],
        }

    @F.pandas_udf(
        "parents array<struct<first:int,last:int>>, children array<struct<parent:int,first:int,last:int>>"
    )
    def pack(owners: pd.Series, sizes: pd.Series, counts: pd.Series, pieces: pd.Series) -> pd.DataFrame:
        rows = [one(*(x.tolist() for x in row)) for row in zip(owners, sizes, counts, pieces)]
        return pd.DataFrame({k: [r[k] for r in rows] for k in ("parents", "children")})

    return pack


def _group_text(items: Column) -> list[Column]:
    pages = F.filter(F.transform(items, lambda s: s["page"]), lambda p: p > 0)
    return [
        T.strip(F.array_join(F.transform(items, lambda s: s["text"]), " ")).alias("text"),
        F.coalesce(F.array_min(pages), F.lit(0)).alias("page_start"),
        F.coalesce(F.array_max(pages), F.lit(0)).alias("page_end"),
        # Sentences and cut pieces never share a token, so sizes add up.
        F.aggregate(items, F.lit(0), lambda n, s: n + s["size"]).alias("tokens"),
    ]


def _members(spans: Column, g: Column) -> Column:
    # Indexed access is constant time; slice() would copy the whole array once per group.
    return F.transform(F.sequence(g["first"], g["last"]), lambda i: F.get(spans, i))


def numbered_id(asset: Column, level: str, number: Column) -> Column:
    """``asset-level-00001``; longer numbers keep all their digits."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)
    return F.concat(asset.cast("string"), F.lit(f"-{level}-"), padded)


def _nonzero(page: Column, otherwise: Column) -> Column:
    return F.when(page != 0, page).otherwise(otherwise)


def chunk_documents(assets: DataFrame, settings: Settings = DEFAULTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two-level chunks of ``assets(asset_id, title, asset_type, content)`` (optional ``asset_pos``), with the columns ``carry``.

    Parents pack a section's sentences to the parent budget; children pack a
    parent's sentences to the child budget with overlap. Numbers run over the
    whole document per level. A document stays one row until the last step, so
    the job has no shuffle and no document waits for another one.
    """
    if "asset_pos" not in assets.columns:
        assets = assets.withColumn("asset_pos", F.lit(0).cast("bigint"))
    keep = ["asset_id", "title", "asset_type", "asset_pos", *carry]
    docs = with_sections(assets.select(*keep, "content"))

    def span(x, owner):
        return F.struct(
            owner.cast("int").alias("owner"),
            x["text"].alias("text"),
            x["page"].alias("page"),
            x["size"].alias("size"),
            hard_split(x, settings.child_tokens).alias("pieces"),
        )

    spans = docs.select(
        *keep,
        F.transform(
            "sections",
            lambda s: F.struct(
                s["heading"].alias("heading"), s["page_start"].alias("page_start"), s["page_end"].alias("page_end")
            ),
        ).alias("heads"),
        F.flatten(
            F.transform(
                "sections",
                lambda s, i: F.transform(
                    F.flatten(
                        F.transform(sentence_spans(s["body"]), lambda x: hard_split(x, settings.parent_tokens))
                    ),
                    lambda x: span(x, i),
                ),
            )
        ).alias("spans"),
    )
    flat = spans.withColumn("pieces", F.flatten(F.transform("spans", lambda s: s["pieces"])))
    grouped = flat.withColumn(
        "groups",
        two_level_packer(settings)(
            F.transform("spans", lambda s: s["owner"]),
            F.transform("spans", lambda s: s["size"]),
            F.transform("spans", lambda s: F.size(s["pieces"])),
            F.transform("pieces", lambda s: s["size"]),
        ),
    )

    def parent(g, i):
        items = _members(F.col("spans"), g)
        return F.struct(
            F.lit("parent").alias("level"),
            (i + 1).cast("int").alias("number"),
            F.lit(0).alias("parent"),
            F.element_at(items, 1)["owner"].alias("section"),
            *_group_text(items),
        )

    leveled = grouped.select(
        *keep, "heads", "pieces", "groups", F.transform("groups.parents", parent).alias("parents")
    )

    def child(g, i):
        owner = F.element_at(F.col("parents"), g["parent"] + 1)
        text, first, last, size = _group_text(_members(F.col("pieces"), g))
        return F.struct(
            F.lit("child").alias("level"),
            (i + 1).cast("int").alias("number"),
            owner["number"].alias("parent"),
            owner["section"].alias("section"),
            text,
            _nonzero(first, owner["page_start"]).alias("page_start"),
            _nonzero(last, owner["page_end"]).alias("page_end"),
            size,
        )

    levels = leveled.select(
        *keep, "heads", "parents", F.transform("groups.children", child).alias("children")
    )
    rows = levels.select(
        *keep, "heads", F.explode_outer(F.concat("parents", "children")).alias("c")
    ).where(F.col("c").isNotNull()).select(*keep, "c.*", F.element_at("heads", F.col("c.section") + 1).alias("head"))
    heading = F.col("head.heading")
    is_body = heading == BODY_HEADING
    anchor = F.concat(F.lit("/assets/"), F.col("asset_id").cast("string"))
    return rows.select(
        "asset_id",
        F.when(F.col("level") == "parent", numbered_id(F.col("asset_id"), "parent", F.col("number")))
        .otherwise(numbered_id(F.col("asset_id"), "child", F.col("number")))
        .alias("chunk_id"),
        F.when(is_body, F.col("title")).otherwise(F.concat("title", F.lit(" · "), heading)).alias("title"),
        "asset_type",
        F.col("text").alias("content"),
        F.when(is_body, anchor).otherwise(F.concat(anchor, F.lit("#"), T.slug(heading))).alias("source_path"),
        F.col("level").alias("chunk_level"),
        F.when(F.col("level") == "parent", F.lit(""))
        .otherwise(numbered_id(F.col("asset_id"), "parent", F.col("parent")))
        .alias("parent_id"),
        heading.alias("section_path"),
        _nonzero(F.col("page_start"), F.col("head.page_start")).alias("page_start"),
        _nonzero(F.col("page_end"), F.col("head.page_end")).alias("page_end"),
        F.col("tokens").alias("token_count"),
        # Corpus order: document order, then chunk number. A text of at most 2 GB has fewer than 2^30 chunks.
        (F.shiftleft(F.col("asset_pos"), 30) + F.col("number")).alias("pos"),
        *carry,
    )
