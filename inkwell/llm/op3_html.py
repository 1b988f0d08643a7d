"""Main text of web pages by removal of site templates.

Each page is parsed once, into text blocks with the hashes of the element subtrees around them. The hashes are counted
per host over distinct page bodies; a subtree that recurs on many pages of its host is template, and its blocks go.
What is left of a page without its menus, forms, scripts, adverts, notices and comments (by element and by class, id
or role) is its main text: the article, else the main element, else the body.

An article's own text is never template, however often a passage recurs; inside it only recurring containers made of
links are. Copies of a whole page count once, so a page posted often does not become template.

Defined results: null or empty html has an empty text; broken markup is read as far as it goes; repeated rows have equal
texts; an empty table gives an empty result; url may be null (its pages share one host); other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import bounded, numbered, stage, table

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea xmp noembed noframes title".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, up to the given boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
IN_P = frozenset("p h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe button select svg menu dialog head title object canvas "
    "textarea input search".split()
)
DROPPED_OUTSIDE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKED = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice banner "
    "sidebar menu navbar nav navigation breadcrumb breadcrumbs footer comment comments disqus reply replies share sharing "
    "social newsletter subscribe signup popup modal overlay pagination pager related recommended".split()
)
MARKED_OUTSIDE = frozenset("header masthead topbar toolbar".split())
KEPT = frozenset("html body article main".split())
CONTAINERS = frozenset("div section ul ol dl table header hgroup figure p span".split())

BLOCK = pa.struct([("text", pa.string()), ("place", pa.int8()), ("inside", pa.list_(pa.int64()))])
PARSED = pa.schema([("uid", pa.int64()), ("page", pa.int64()), ("subtrees", pa.list_(pa.int64())), ("blocks", pa.list_(BLOCK))])
PARSED_SQL = "uid bigint, page bigint, subtrees array<bigint>, blocks array<struct<text:string,place:tinyint,inside:array<bigint>>>"
ARTICLE, MAIN, BODY = 2, 1, 0


class _Element:
    __slots__ = ("name", "dropped", "place", "digest", "links", "length", "children", "number")

    def __init__(self, name: str, dropped: bool, place: int, number: int):
        self.name, self.dropped, self.place, self.number = name, dropped, place, number
        self.digest, self.links, self.length = xxhash.xxh3_64(name), 0, 0


def _removed(name: str, attributes: str, place: int) -> bool:
    """Elements that are never main text, by name, role, class, id or hiding."""
    if name in KEPT and not (name == "article" and place):
        return False
    if name in DROPPED or (not place and name in DROPPED_OUTSIDE):
        return True
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            words = set(re.findall(r"[a-z]+", value))
            if words & MARKED or (not place and words & MARKED_OUTSIDE):
                return True
    return False


class _Page:
    def __init__(self, source: str):
        self.stack: list[_Element] = []
        self.text: list[str] = []
        self.blocks: list[tuple[str, int, list[int]]] = []
        self.hashes: dict[int, int] = {}
        self.numbers = 0
        self.paragraphs = 0
        self.anchors = 0
        self.linked = 0
        self._parse(source)

    def _parse(self, s: str) -> None:
        at, end = 0, len(s)
        while at < end:
            lt = s.find("<", at)
            if lt < 0:
                self._data(s[at:])
                break
            if lt > at:
                self._data(s[at:lt])
            if s.startswith("<!--", lt):
                close = s.find("-->", lt + 4)
                at = end if close < 0 else close + 3
                continue
            if s.startswith(("<!", "<?"), lt):
                close = s.find(">", lt)
                at = end if close < 0 else close + 1
                continue
            m = TAG.match(s, lt) or LOOSE_TAG.match(s, lt)
            if m is None:
                self._data("<")
                at = lt + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._close(name)
            else:
                self._open(name, m[3])
                if name in RAW:
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(s, at)
                    at = end if close is None else close.start()
        while self.stack:
            self._pop()
        self._flush()

    def _data(self, data: str) -> None:
        if self.stack and self.stack[-1].name in RAW:
            return
        self.text.append(html.unescape(data) if "&" in data else data)
        if self.anchors:
            self.linked += len(data)

    def _flush(self) -> None:
        if not self.text:
            return
        text = " ".join("".join(self.text).split())
        self.text, linked, self.linked = [], self.linked, 0
        if not text:
            return
        top = self.stack[-1] if self.stack else None
        if top is not None:
            top.digest.update(text.encode("utf-8", "surrogatepass"))
            top.length += len(text)
            top.links += linked
        if top is None or not top.dropped:
            self.blocks.append((text, top.place if top else BODY, [e.number for e in self.stack if e.name in CONTAINERS]))

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
            if self.paragraphs:
                self._end_paragraph()
        elif name in ("br", "wbr"):
            self.text.append(" " if name == "br" else "")
        if name in CLOSES:
            ends, limit = CLOSES[name]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name in limit:
                    break
                if self.stack[i].name in ends:
                    self._pop_to(i)
        if name in VOID or (attributes.endswith("/") and name not in BLOCKS and name not in RAW):
            return
        top = self.stack[-1] if self.stack else None
        place = top.place if top else BODY
        dropped = (top.dropped if top else False) or _removed(name, attributes, place)
        if name == "article":
            place = ARTICLE
        elif name == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes):
            place = max(place, MAIN)
        self.numbers += 1
        self.paragraphs += name in IN_P
        self.anchors += name == "a"
        self.stack.append(_Element(name, dropped, place, self.numbers))

    def _end_paragraph(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].name
            if name in IN_P:
                self._pop_to(i)
                return
            if name in BLOCKS:
                return

    def _close(self, name: str) -> None:
        if name == "br":
            self.text.append(" ")
        if name in BLOCKS:
            self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                self._pop_to(i)
                return
            if name not in BLOCKS and self.stack[i].name in BLOCKS:
                return

    def _pop_to(self, i: int) -> None:
        self._flush()
        while len(self.stack) > i:
            self._pop()

    def _pop(self) -> None:
        if self.stack[-1].name in BLOCKS or len(self.stack) == 1:
            self._flush()
        e = self.stack.pop()
        self.paragraphs -= e.name in IN_P
        self.anchors -= e.name == "a"
        value = e.digest.intdigest()
        if self.stack:
            above = self.stack[-1]
            above.digest.update(value.to_bytes(8, "little"))
            above.length += e.length
            above.links += e.links
        if e.length and (e.place == BODY or e.name in CONTAINERS):
            template = e.place == BODY or 2 * e.links >= e.length
            if template and e.name not in KEPT:
                self.hashes[e.number] = value - (1 << 63)


def parse(source: str | None) -> tuple[int, list[int], list[tuple[str, int, list[int]]]]:
    """Body hash, hashes of possible template subtrees, and blocks as (text, place, hashes around it)."""
    page = _Page(source or "")
    best = max((place for _, place, _ in page.blocks), default=BODY)
    blocks = [(t, p, [page.hashes[n] for n in around if n in page.hashes]) for t, p, around in page.blocks if p == best]
    whole = xxhash.xxh3_64_intdigest("\n".join(t for t, _, _ in page.blocks).encode("utf-8", "surrogatepass"))
    return whole - (1 << 63), sorted(set(page.hashes.values())), blocks


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [parse(source) for source in batch.column("html").to_pylist()]
        blocks = [[{"text": t, "place": p, "inside": i} for t, p, i in b] for _, _, b in pages]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("uid"),
                pa.array([p for p, _, _ in pages], pa.int64()),
                pa.array([h for _, h, _ in pages], pa.list_(pa.int64())),
                pa.array(blocks, pa.list_(BLOCK)),
            ],
            schema=PARSED,
        )


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.005, broadcast_rows: int = 200_000) -> DataFrame:
    """Returns page_id, url, text. A subtree is template from ``min_pages`` distinct pages and ``min_share`` of its host's.

    ``broadcast_rows`` bounds the broadcast of pages whose blocks stand in a template; more are joined by a shuffle.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = numbered(pages.select("page_id", "url", host.alias("host"), "html"), "uid")
    parsed = rows.mapInArrow(_parse_rows, f"page_id {_type(pages, 'page_id')}, url string, host string, {PARSED_SQL}")
    parsed = stage(parsed, "parsed")

    seen = parsed.select("host", "page", F.explode("subtrees").alias("subtree"))
    counted = seen.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    hosts = parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    template = counted.join(hosts, "host").where(F.col("n") >= min_share * F.col("pages")).select("host", "subtree")
    template = stage(template, "template")
    around = parsed.select("uid", "host", F.explode(F.array_distinct(F.flatten("blocks.inside"))).alias("subtree"))
    hit = around.join(template, ["host", "subtree"]).groupBy("uid").agg(F.collect_set("subtree").alias("template"))

    clean = F.filter("blocks", lambda b: F.col("template").isNull() | ~F.arrays_overlap(b["inside"], F.col("template")))
    text = F.array_join(F.transform(clean, lambda b: b["text"]), "\n")
    hit = bounded(stage(hit, "hit"), broadcast_rows)
    return parsed.join(hit, "uid", "left").select("page_id", "url", text.alias("text"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (parsed,) = _parse_batches(iter([batch]))
        first = [batch.column(c) for c in ("page_id", "url", "host")]
        yield pa.RecordBatch.from_arrays(first + parsed.columns, ["page_id", "url", "host", *parsed.schema.names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
