"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only, leading boilerplate such as comment
marks and list numbers gone), and known licence sentences are mapped to identifiers. A licence rule is an ordered sequence
of identifiers; it matches where its identifiers occur in that order with at most ``max_gap`` unknown sentences between
two of them. Rules are tried from the longest to the shortest, and a sentence serves one match only, so the
full text of a licence is not reported again as its notice.

Defined results: null and empty texts have no licence; repeated rows are scanned each; an empty table gives an empty
result; only the identifier and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import table

# Sentences of published licences and of their usual notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-name": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-name": "Licensed under the BSD License",
    "bsd3-name": "Licensed under the BSD 3-Clause License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-file": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-specific": "See the License for the specific language governing permissions and limitations under the License",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl2-name": "This work is licensed under the GNU General Public License, version 2",
    "lgpl-name": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl-name": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0-name": "Licensed under CC0 1.0",
    "cc-by-name": "Licensed under CC BY 4.0",
    "cc-by-sa-name": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-name": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-name": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-name": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "all-rights": "All rights reserved",
}

# Licence, kind of match, ordered sentence identifiers.
RULES = [
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("ISC", "text", ("isc-grant", "isc-warranty")),
    ("Apache-2.0", "notice", ("apache-notice", "apache-copy", "apache-as-is", "apache-specific")),
    ("Apache-2.0", "notice", ("apache-licensed-the", "apache-file", "apache-copy", "apache-as-is", "apache-specific")),
    ("Apache-2.0", "notice", ("apache-notice",)),
    ("Apache-2.0", "notice", ("apache-licensed-the", "apache-file")),
    ("Apache-2.0", "name", ("apache-licensed",)),
    ("GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", "notice", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", "notice", ("gpl-free",)),
    ("GPL-2.0-or-later", "notice", ("gpl2-free",)),
    ("GPL-3.0-only", "name", ("gpl3-name",)),
    ("GPL-3.0-only", "name", ("gpl3-licensed",)),
    ("GPL-2.0-only", "name", ("gpl2-name",)),
    ("LGPL-3.0-only", "name", ("lgpl-name",)),
    ("AGPL-3.0-only", "name", ("agpl-name",)),
    ("MPL-2.0", "notice", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", "notice", ("mpl-form",)),
    ("Unlicense", "text", ("unlicense",)),
    ("MIT", "name", ("mit-name",)),
    ("MIT", "name", ("mit-licensed",)),
    ("MIT", "name", ("mit-title",)),
    ("BSD-3-Clause", "name", ("bsd3-name",)),
    ("BSD", "name", ("bsd-name",)),
    ("CC0-1.0", "name", ("cc0-name",)),
    ("CC-BY-4.0", "name", ("cc-by-name",)),
    ("CC-BY-SA-4.0", "name", ("cc-by-sa-name",)),
    ("CC-BY-NC-4.0", "name", ("cc-by-nc-name",)),
    ("CC-BY-ND-4.0", "name", ("cc-by-nd-name",)),
    ("CC-BY-NC-SA-4.0", "name", ("cc-by-nc-sa-name",)),
    ("CC-BY-4.0", "name", ("cc-by-work",)),
    ("CC-BY-SA-4.0", "name", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", "name", ("cc-by-nc-work",)),
]

# A point, colon or semicolon ends a sentence before white space; so do an empty line and the end of a one-line notice.
BREAK = re.compile(r"(?<=[.!?:;])[\"')\]]*\s+|\n\s*\n")
# A point in a holder's name ("neither the name of Google Inc. nor ...") ends none, if the name has less than 200 characters.
OPEN_NAME = re.compile(r"\bneither\s+the\s+names?\s+of\b(?!.*\bnor\s+the\s+names?\b)", re.I | re.S)
EDGE = re.compile(r"[^a-z0-9]+")
NUMBERING = re.compile(r"^(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|[*#/;-]+)\s+")


#: The slot for the holder's name in an endorsement sentence.
HOLDER = re.compile(r"\bneither the names? of .{1,200}? nor the names of (?:its|any)(?: other)? contributors\b")
HOLDER_FILLED = "neither the name of the copyright holder nor the names of its contributors"


def normal(sentence: str) -> str:
    """Lower case words without numbering and punctuation; a holder's name becomes the words that fill its slot."""
    words = EDGE.sub(" ", NUMBERING.sub("", sentence.strip().lower())).strip()
    return HOLDER.sub(HOLDER_FILLED, words) if "neither the name" in words else words


def _parts(sentence: str) -> list[str]:
    return [p for p in map(normal, BREAK.split(sentence)) if p]


def _known() -> dict[tuple[str, ...], str]:
    """Identifiers by the normalised pieces of a known sentence; a sentence may itself hold sentence ends."""
    return {tuple(_parts(text)): name for name, text in SENTENCES.items()}


KNOWN = _known()
FIRST: dict[str, list[tuple[str, ...]]] = {}
for _pieces in sorted(KNOWN, key=len, reverse=True):
    FIRST.setdefault(_pieces[0], []).append(_pieces)
ORDERED = sorted(RULES, key=lambda r: -len(r[2]))
#: Every known sentence begins with one of these words, so a text without any of them cannot match.
STARTS = re.compile(r"\b(?:" + "|".join(sorted({p[0].split()[0] for p in KNOWN})) + r")\b", re.I)


def _segments(text: str) -> Iterator[tuple[str, int, int]]:
    """Normalised sentences with their place. Lines are joined inside a sentence, and also tried one by one."""
    at = 0
    for m in [*BREAK.finditer(text), None]:
        end = len(text) if m is None else m.start()
        if m is not None and m[0].count("\n") < 2 and OPEN_NAME.search(text, max(at, end - 200), end):
            continue
        if normal(text[at:end]):
            yield normal(text[at:end]), at, end
        at = end if m is None else m.end()


def sentence_ids(text: str | None) -> list[tuple[str | None, int, int]]:
    """The text's sentences in order as (identifier or None, start, end) in code points."""
    if not text or not STARTS.search(text):
        return []
    segments: list[tuple[str, int, int]] = []
    wrapped = 0
    for sentence, start, end in _segments(text):
        lines = text[start:end].split("\n")
        if len(lines) > 1 and sentence not in FIRST:
            at = start
            for line in lines:
                if normal(line):
                    segments.append((normal(line), at, at + len(line)))
                at += len(line) + 1
            wrapped = len(segments)
        else:
            segments.append((sentence, start, end))
    segments = _rejoined(segments[:wrapped]) + segments[wrapped:]
    out, i = [], 0
    while i < len(segments):
        for pieces in FIRST.get(segments[i][0], ()):
            if tuple(s for s, _, _ in segments[i : i + len(pieces)]) == pieces:
                out.append((KNOWN[pieces], segments[i][1], segments[i + len(pieces) - 1][2]))
                i += len(pieces)
                break
        else:
            out.append((None, segments[i][1], segments[i][2]))
            i += 1
    return out


_BEGINNINGS = {" ".join(p[0].split()[:3]) for p in KNOWN}
_LONGEST = max(len(p) for pieces in KNOWN for p in pieces)


def _rejoined(segments: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Joins lines again that together form a known sentence; wrapped licence texts keep their line breaks."""
    out, i = [], 0
    while i < len(segments):
        whole, j = segments[i][0], i
        if whole not in FIRST and " ".join(whole.split()[:3]) in _BEGINNINGS:
            while j + 1 < len(segments) and whole not in FIRST and len(whole) < _LONGEST:
                j += 1
                whole = f"{whole} {segments[j][0]}"
        if whole in FIRST:
            out.append((whole, segments[i][1], segments[j][2]))
            i = j + 1
        else:
            out.append(segments[i])
            i += 1
    return out


def licences(text: str | None, max_gap: int = 3) -> list[dict]:
    """Matches as licence, kind, sentences, start, end; in order of their place."""
    found = sentence_ids(text)
    places: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(found):
        if name is not None:
            places.setdefault(name, []).append(i)
    used: set[int] = set()
    out = []
    for licence, kind, names in ORDERED:
        for first in places.get(names[0], ()):
            chain = [first]
            for name in names[1:]:
                near = (i for i in range(chain[-1] + 1, min(len(found), chain[-1] + max_gap + 2)) if found[i][0] == name and i not in used)
                chain.append(next(near, -1))
                if chain[-1] < 0:
                    break
            if chain[-1] >= 0 and first not in used:
                used.update(chain)
                out.append({"licence": licence, "kind": kind, "sentences": len(chain), "start": found[first][1], "end": found[chain[-1]][2]})
    return sorted(out, key=lambda m: (m["start"], m["licence"]))


MATCH = pa.struct([("licence", pa.string()), ("kind", pa.string()), ("sentences", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_gap: int = 3) -> DataFrame:
    """``id_col`` and ``matches``: an array of (licence, kind, sentences, start, end) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [licences(t, max_gap) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(MATCH))], ["id", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    matches = "array<struct<licence:string,kind:string,sentences:bigint,start:bigint,end:bigint>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, matches {matches}").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its licences in order, and where they stand."""
    found = scan(table(spark, sf_dir, "documents"))
    place = F.transform("matches", lambda m: F.concat_ws(":", m["licence"], m["kind"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_distinct(F.transform("matches", lambda m: m["licence"])), ",").alias("licences"),
        F.array_join(place, ",").alias("matches"),
    )
