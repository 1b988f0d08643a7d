"""Spelling variants against brute force over all pairs, with tiny blocks, nulls, ties, repeated rows and clashing columns."""

import random
import re
import string
import zlib
from collections import Counter

import pytest

from inkwell.llm import op13_spelling_variants as op


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_groups(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    stems = ["colour", "Neighbour", "élève", "straße", "naïve×÷", "aaaaa", "banana", "letter", "zzzzzzzz", "x" * 300]
    texts = []
    for _ in range(400):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                p, c = rng.randrange(len(w)), rng.choice("abeélrÉ")
                w[p : p + rng.randrange(2)] = [c] if rng.random() < 0.7 else []
            words.append("".join(w))
        texts.append(rng.choice([" ", ", ", "\n", "1", "—"]).join(words))
    out = list(enumerate(texts)) + [(None, "null identifier identifier"), (900, None), (901, ""), (902, "!!! 123 \U0001f600")]
    return out + out[:30] + [(903, "longword " * 5000 + "Ünlong")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y", 1) for r in rows], "doc_id bigint, text string, word string, n int, form string, length int")


def test_counts_of_any_slicing(spark, rows):
    got = op.vocabulary(frame(spark, rows).repartition(4), held=50).collect()
    assert {r["word"]: r["n"] for r in got} == brute_counts(rows)
    text = "ab cdéf  ghij×k 12 " * 50
    for size in (1, 3, 7, 1000):
        assert sum(op.run_slices(text, size), []) == op.RUN.findall(text)


@pytest.mark.parametrize(("sample", "block"), [(op.SAMPLE, op.BLOCK), (300, 6), (1, 40)])
def test_groups_equal_brute_force(spark, rows, sample, block):
    words = op.vocabulary(frame(spark, rows))
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in op.grouped(words, sample, block).collect()}
    want = brute_groups(brute_counts(rows))
    assert got == want
    assert any(v[1] not in (k, v[0]) for k, v in want.items())  # chains of several forms occur


def test_pairs_of_dense_random_words():
    rng = random.Random(1)
    for length, letters in ((5, "ab"), (6, "abc"), (7, "aé"), (9, string.ascii_lowercase)):
        base = sorted({"".join(rng.choices(letters, k=length)) for _ in range(150)})
        shorter = sorted({"".join(rng.choices(letters, k=length - 1)) for _ in range(80)} | {w[1:] for w in base[:20]})
        for queries, same in ((base, True), (shorter, False)):
            i, j = op.near_pairs(base, queries, same, leaf=4)
            want = sorted((q, b) for q in queries for b in base if one_edit(q, b))
            assert sorted((queries[a], base[b]) for a, b in zip(i, j, strict=True)) == want
    assert len(op.near_pairs([], ["abcde"], True)[0]) == 0


def test_empty_table(spark, rows):
    assert op.grouped(op.vocabulary(frame(spark, rows[:1]).limit(0))).count() == 0
