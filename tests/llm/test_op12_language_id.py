"""Language identification: features and decoding against brute force, held-out accuracy, and unusual rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from inkwell.llm import op12_language_id as op

SYLLABLES = {"aa": "ba ko nu ti ré", "bb": "sch ung ein ö ch", "cc": "the ing er on th", "dd": "ción ñ os la el", "ee": "ж б е л и"}


def text_of(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(i, text_of(rng, lang := rng.choice(sorted(SYLLABLES)), rng.choice([1, 3, 30, 200])), lang) for i in range(600)]
    out += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 345 !?", "bb"), (None, text_of(rng, "cc", 20), "cc"), (1003, text_of(rng, "dd", 20), None)]
    return out + out[:20] + [(1004, text_of(rng, "ee", 100_000), "ee"), (1005, "² ½ _ \U0001f600", None)]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1.0, True) for r in rows], "doc_id bigint, text string, lang string, vector string, score double, held_out boolean"
    )


def grams(text):
    """Brute force: the multiset of letter n-grams, as strings."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    s = " " + " ".join(words) + " "
    return sorted(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " ")


def test_grams_of_any_slicing_equal_brute_force():
    for text in ("ab c", "Été, là-bas 12x", " a", "a ", "ab\U0001f600cd" * 9, "x" * 40):
        one = {g: op.gram_counts(text) for g in [0]}[0]
        assert one.sum() == len(grams(text))
        for size in (1, 2, 3, 5, 17):
            assert (op.gram_counts(text, size) == one).all()
    assert op.gram_counts("Été") is not None and (op.gram_counts("ÉTÉ!") == op.gram_counts("été")).all()
    assert [op.gram_counts(t) for t in ("", " 1², ½_", "\U0001f600")] == [None] * 3


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 5, 9, 40])
def test_codewords(k):
    code = op.codewords(k)
    assert code.shape[0] == k and (k > 5 or code.shape[1] == max(0, 2 ** (k - 1) - 1))
    columns = [tuple(c) for c in code.T] + [tuple(1 - c) for c in code.T]
    assert len(set(columns)) == len(columns)
    assert all((a != b).any() for a, b in itertools.combinations(code, 2))


def test_decoding_equals_brute_force():
    rng = np.random.default_rng(0)
    code = op.codewords(6)
    model = op.Model(list("abcdef"), code, np.zeros((op.BUCKETS + 1, code.shape[1])), rng.random(code.shape[1]), 0.2)
    margins = rng.normal(size=(20, code.shape[1])) * 3
    for row, shares in zip(margins, model.shares(margins), strict=True):
        loss = [sum(t * math.log1p(math.exp(-m * (1 if b else -1))) for m, b, t in zip(row, c, model.trust, strict=True)) for c in code]
        assert int(np.argmin(loss)) == int(np.argmax(shares))
        want = np.exp(-np.array(loss))
        assert np.allclose(shares, want / want.sum())


def test_held_out_accuracy_and_unusual_rows(spark, rows):
    docs = frame(spark, rows).repartition(3)
    got = op.identified(docs, sample=400).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    judged = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert judged and sum(r["lang_pred"] == truth[r["doc_id"]] for r in judged) >= 0.95 * len(judged)
    by = {r["doc_id"]: r for r in got}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1000, 1001, 1002, 1005))
    assert (by[1003]["lang_pred"], by[1004]["lang_pred"], by[None]["lang_pred"]) == ("dd", "ee", "cc")
    again = op.identified(docs.repartition(7), sample=400).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in again} == {(r["doc_id"], r["lang_pred"]) for r in got}


def test_ambiguous_rows_are_flagged(spark, rows):
    model = op.learn(frame(spark, rows), sample=400)
    clear, mixed = text_of(random.Random(1), "aa", 30), " ".join(text_of(random.Random(2), lang, 60) for lang in ("aa", "bb"))
    model.ambiguous_below = 0.999
    assert op.predict([mixed], model)[0][3] and not op.predict([clear], op.Model(model.languages, model.code, model.weights, model.trust, 0.05))[0][3]


def test_few_languages_and_empty_tables(spark, rows):
    one = [(r[0], r[1], "aa") for r in rows[:30]]
    assert {(r["lang_pred"], r["score"]) for r in op.identified(frame(spark, one)).collect()} == {("aa", 1.0)}
    none = [(r[0], r[1], None) for r in rows[:5]]
    assert {r["lang_pred"] for r in op.identified(frame(spark, none)).collect()} == {"und"}
    assert op.identified(frame(spark, one).limit(0)).count() == 0
