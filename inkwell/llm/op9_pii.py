"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Base kinds are email, ip, card and phone. Their spans stay whenever the pattern and its validator agree (number parts,
Luhn, digit count); context can only raise their score. The method adds IBANs confirmed by mod-97, and national numbers
and local phone numbers that need a context word close by. Added spans never overlap base ones.

Offsets are code points, the end is exclusive. Matches are leftmost and do not overlap within a kind; a base match that
fails its validator is dropped without a retry. Every base pattern consumes whole runs; an IBAN is tried at each of its
possible starts, within its country's length, so the time is linear in the text.

Defined results: a null or empty text has no spans; repeated rows are scored alike; an empty table gives an empty
result; only the identifier and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "national_id", "local_phone")
KINDS = BASE + EXTRA
THRESHOLD = 0.5
WINDOW = 48

# A run that lacks the rest of its pattern is consumed as a whole: no later start inside it could match either.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]+((?:\.[0-9]+){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9]{4})")
#: The characters after the check digits: groups of four, of which the last may be shorter.
IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
#: Characters of a country's IBANs; other country codes may end after any group.
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (part.split(":") for part in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")

CONTEXT = {
    "email": re.compile(r"e-?mail|contact|courriel|correo|kontakt", re.I),
    "ip": re.compile(r"\bip\b|address|server|host|adresse|servidor", re.I),
    "card": re.compile(r"card|visa|credit|payment|carte|karte|tarjeta", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|telefon|téléphone|teléfono", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
    "national_id": re.compile(r"\bssn\b|social security|national (?:id|insurance)|tax id", re.I),
    "local_phone": re.compile(r"phone|\btel\b|\btel[.:]|call (?:me|us|now)|mobile|fax|telefon|téléphone|teléfono", re.I),
}
#: Score of a confirmed proposal without and with a context word nearby.
SCORES = {
    "email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95),
    "iban": (0.8, 1.0), "national_id": (0.3, 0.8), "local_phone": (0.3, 0.7),
}

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_end(text: str, start: int) -> int | None:
    """End of the longest IBAN at ``start`` that has its country's length, stops at a word's end and agrees with mod-97."""
    run = IBAN_REST.match(text, start + 4)
    if run is None:
        return None
    length = IBAN_LENGTHS.get(text[start : start + 2])
    for end in range(run.end(), start + 14, -1):
        if text[end - 1] == " " or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
            continue
        plain = text[start:end].replace(" ", "")
        if (len(plain) == length if length else 15 <= len(plain) <= 34) and mod97(plain):
            return end
    return None


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of each kind in order; quick tests skip patterns that cannot match."""
    if "@" in text:
        for m in EMAIL.finditer(text):
            if m[1] is not None:
                yield "email", m.start(), m.end()
    first = re.search("[0-9]", text)
    if first is None:
        return
    at = first.start()
    if "." in text:
        for m in IP.finditer(text, at):
            if m[1] is not None and all(_small(p) for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text, at):
        if 13 <= len(number := _digits(m[0])) <= 19 and luhn(number):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    behind = 0
    for m in IBAN.finditer(text, max(0, at - 2)):
        end = _iban_end(text, m.start()) if m.start() >= behind else None
        if end is not None:
            behind = end
            yield "iban", m.start(), end
    for m in NATIONAL.finditer(text, at):
        yield "national_id", m.start(), m.end()
    for m in LOCAL.finditer(text, max(0, at - 1)):
        yield "local_phone", m.start(), m.end()


def spans_of(text: str | None) -> list[dict]:
    found: list[dict] = []
    base: list[tuple[int, int]] = []
    for kind, start, end in _proposals(text or ""):
        around = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
        score = SCORES[kind][CONTEXT[kind].search(around) is not None]
        if kind in BASE:
            base.append((start, end))
        elif score < THRESHOLD or any(start < e and s < end for s, e in base):
            continue
        found.append({"kind": kind, "start": start, "end": end, "value": text[start:end], "score": score})
    return found


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [spans_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(SPAN))], ["id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``id_col`` and ``spans``: an array of (kind, start, end, value, score), by kind and then start."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find, f"id {kind}, spans {spans}").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the text with every span replaced by its kind in angle brackets."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                parts, at = [], 0
                for s in sorted(spans_of(text), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{s['kind']}>"]
                        at = s["end"]
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mask, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": text_col})


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
