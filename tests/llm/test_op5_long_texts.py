"""Licence sentences in wrapped, long and named texts."""

import time

from inkwell.llm import op5_licenses as L



def bsd(holder):
    known = [t for t in L.SENTENCES.values() if "neither the name" in t.lower()]
    assert known
    rule = next(names for licence, _, names in L.RULES if licence == "BSD-3-Clause" and len(names) > 2)
    texts = {name: text for text, name in zip(L.SENTENCES.values(), L.SENTENCES)}
    out = [texts[n] for n in rule]
    return "\n\n".join(t.replace("the copyright holder", holder) if "either the name" in t else t for t in out)


def test_holder_names_fill_the_slot():
    for holder in ("the copyright holder", "Google Inc.", "Google Inc", "the University of X,\nBerkeley", "ACME GmbH & Co. KG"):
        assert [m["licence"] for m in L.licences(bsd(holder))] == ["BSD-3-Clause"], holder


def test_long_wrapped_texts_take_linear_time():
    line = "some words of a long text\nthat goes on over lines and never ends in a notice of permission.\n"
    text = line * 20_000
    start = time.perf_counter()
    assert L.licences(text) == []
    assert time.perf_counter() - start < 30
    marked = text + "\n\n" + bsd("Google Inc.").replace(", ", ",\n") + "\n\n" + line
    assert [m["licence"] for m in L.licences(marked)] == ["BSD-3-Clause"]


def test_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, bsd("X")), (1, bsd("X")), (2, None), (3, "")], "doc_id long, text string")
    found = sorted((r.doc_id, [m.licence for m in r.matches]) for r in L.scan(rows).collect())
    assert found == [(1, ["BSD-3-Clause"]), (1, ["BSD-3-Clause"]), (2, []), (3, [])]
    assert L.scan(rows.limit(0)).isEmpty()
