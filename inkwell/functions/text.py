"""Column functions over text: normalising, tokenising, slugs, cuts and ids.

All of them are plain Catalyst expressions; none needs a Python worker.
Patterns are written so that Java and RE2 read them the same way, hence the
explicit white-space class instead of ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_RANGES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CLASS = f"[{WS_RANGES}]"
NOT_WS_CLASS = f"[^{WS_RANGES}]"
LINE_BREAKS = "[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Token patterns.
CJK_RUN = "[\u4e00-\u9fff]+"
LATIN_TOKEN = "[a-zA-Z0-9_./-]+"
# A Latin run is one token; so is any other visible character, CJK included.
ROUGH_TOKEN = f"{LATIN_TOKEN}|{NOT_WS_CLASS}"
# The same tokens for the scans of whole corpora: the ASCII word class is one test, a list of ranges one test per range.
LATIN_RUN = r"[\w./-]+"
COUNTED_TOKEN = rf"(?:{LATIN_RUN}|[!-~]|{NOT_WS_CLASS}) *"
EMPTY_TOKEN = "__empty__"
UNNAMED = "未命名"
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def lits(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else no_strings()


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def collapse_spaces(col: Column) -> Column:
    """Every white-space run becomes one blank; ends are trimmed."""
    return F.btrim(F.regexp_replace(col, f"{WS_CLASS}+", " "), F.lit(" "))


def normalize_newlines(col: Column) -> Column:
    return strip(F.regexp_replace(col, "\r\n?", "\n"))


def collapse_blank_lines(col: Column) -> Column:
    return strip(F.regexp_replace(col, "\n{3,}", "\n\n"))


def clip(col: Column, limit: int) -> Column:
    return F.substring(col, 1, limit)


def bound(col: Column, use) -> Column:
    """``use(col)``, with ``col`` evaluated once however often ``use`` names it."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def _clipped(col: Column, limit: int, form) -> Column:
    """``clip(form(col), limit)`` for a ``form`` whose value for a beginning of the text begins its value for the whole text.

    Where the first ``2 * limit`` characters fill the limit, the rest cannot matter; every other text is formed whole. Lower
    case depends on later characters for the sigma only, so beginnings that hold one decide nothing.
    """

    def one(text: Column) -> Column:
        start = F.substring(text, 1, 2 * limit)
        decides = lambda cut: (F.length(start) < 2 * limit) | ((F.length(cut) >= limit) & ~F.contains(start, F.lit("\u03a3")))
        return bound(clip(form(start), limit), lambda cut: F.when(decides(cut), cut).otherwise(clip(form(text), limit)))

    return bound(col, one)


def compact(col: Column, limit: int = 240) -> Column:
    """Collapse, trim, cut (memory flavour: may be empty)."""
    return _clipped(col, limit, collapse_spaces)


def compact_named(col: Column, limit: int = 80) -> Column:
    """Collapse, cut, trim, with a default title for empty text (service flavour)."""
    cut = strip(compact(col, limit))
    return F.when(cut == "", F.lit(UNNAMED)).otherwise(cut)


def excerpt(col: Column, empty_text: str, limit: int = 1200) -> Column:
    text = strip(F.coalesce(col, F.lit("")))
    return F.when(text == "", F.lit(empty_text)).otherwise(strip(clip(text, limit)))


# --- tokens -----------------------------------------------------------------


def tokenize(col: Column) -> Column:
    """Distinct tokens in first-seen order: CJK runs first, then lower-cased Latin words."""
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(col, F.lit(CJK_RUN), F.lit(0)),
            F.regexp_extract_all(F.lower(col), F.lit(LATIN_RUN), F.lit(0)),
        )
    )


def fallback_token(col: Column) -> Column:
    text = F.lower(strip(col))
    return F.when(text == "", F.lit(EMPTY_TOKEN)).otherwise(text)


def with_fallback(tokens: Column, col: Column) -> Column:
    return F.when(F.size(tokens) == 0, F.array(fallback_token(col))).otherwise(tokens)


def bm25_tokens(col: Column) -> Column:
    return with_fallback(tokenize(col), col)


def rough_tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(ROUGH_TOKEN), F.lit(0))


def token_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(COUNTED_TOKEN))


# --- slugs, names, ids --------------------------------------------------------


def slug(col: Column, limit: int = 72, default: str = "chunk") -> Column:
    """Anchor slug: runs of non-word characters become ``-``."""
    dashed = lambda text: F.btrim(F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}_]+", "-"), F.lit("-"))
    cut = _clipped(col, limit, dashed)
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def key_slug(col: Column, limit: int = 48, default: str = "item") -> Column:
    """Memory-key slug: only ASCII letters, digits and CJK survive."""
    scored = lambda text: F.btrim(F.regexp_replace(F.lower(strip(text)), "[^a-zA-Z0-9\u4e00-\u9fff]+", "_"), F.lit("_"))
    cut = _clipped(col, limit, scored)
    return F.when(cut == "", F.lit(default[:limit])).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    name = base_name(path)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    return F.when(stem == "", name).otherwise(stem)


def safe_object_name(path: Column) -> Column:
    name = strip(base_name(path))
    name = F.when(name == "", F.lit("upload")).otherwise(name)
    cut = clip(F.regexp_replace(name, "[^A-Za-z0-9_.\\-\u4e00-\u9fff]+", "_"), 180)
    return F.when(cut == "", F.lit("upload")).otherwise(cut)


def normalized_md5(col: Column) -> Column:
    """The trimmed lower-case digest, or NULL when it is not a 32-digit hex string."""
    digest = F.lower(strip(col))
    return F.when(digest.rlike("^[0-9a-f]{32}$"), digest)


def point_id(col: Column) -> Column:
    """Name-based (SHA-1) UUID of the id in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(col, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


# --- arrays of strings --------------------------------------------------------


def distinct_texts(values: Column) -> Column:
    """White-space-normalised values without empties, each kept at its first position."""
    return F.array_distinct(F.filter(F.transform(values, collapse_spaces), lambda v: v != ""))


def contains_any(col: Column, terms) -> Column:
    """True when any of the fixed terms occurs in the text."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(col, F.lit(term))
    return found


def find(haystack: Column, needle: Column, start: int = 1) -> Column:
    """0-based position of ``needle``, -1 when absent."""
    return F.call_function("locate", needle, haystack, F.lit(start)) - 1


def joined(values: Column, separator: str) -> Column:
    return F.array_join(values, separator)


def short_sentences(col: Column, limit: int = 3) -> Column:
    parts = F.transform(F.split(col, "[。\n!?；;]+"), strip)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, limit)


# --- document canonical forms ---------------------------------------------------


def strip_front_matter(text: Column) -> Column:
    """Text after a leading ``---`` block; ``text`` must have normalised newlines already."""
    closing = F.call_function("locate", F.lit("\n---\n"), text, F.lit(5))
    return F.when(
        F.startswith(text, F.lit("---\n")) & (closing > 0), lstrip(F.substring(text, closing + 5, F.length(text)))
    ).otherwise(text)


def source_line(filename: Column) -> Column:
    return F.concat(F.lit("来源文件："), filename)


def page_text(col: Column) -> Column:
    """Extracted page text: wrapped lines join with blanks, blank lines separate paragraphs."""
    lines = F.transform(F.split(normalize_newlines(col), LINE_BREAKS), collapse_spaces)
    # An empty line becomes a paragraph mark; a run of marks is one break.
    marked = F.array_join(F.transform(lines, lambda s: F.when(s == "", F.lit("\n")).otherwise(s)), " ")
    return strip(F.regexp_replace(marked, " ?\n[ \n]*", "\n\n"))


def infer_asset_type(filename: Column, provided: Column) -> Column:
    explicit = strip(F.coalesce(provided, F.lit("")))
    suffix = file_suffix(filename)
    return (
        F.when(explicit != "", explicit)
        .when(suffix == ".pdf", F.lit("pdf"))
        .when(suffix.isin(".md", ".markdown"), F.lit("markdown"))
        .otherwise(F.lit("note"))
    )


def asset_title(filename: Column, provided: Column) -> Column:
    return strip(F.when(F.coalesce(provided, F.lit("")) != "", provided).otherwise(file_stem(filename)))


def asset_title_full_name(filename: Column, provided: Column) -> Column:
    """Second flavour: the default title keeps the suffix."""
    return strip(F.when(F.coalesce(provided, F.lit("")) != "", provided).otherwise(base_name(filename)))
