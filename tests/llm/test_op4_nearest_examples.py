"""Nearest labelled examples over all words: copies of examples are found, cosines and scores equal brute force."""

import math
import random
import zlib

import numpy as np
import pytest

from inkwell.llm import op4_toxicity as op


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(44)
    text = lambda: " ".join(f"w{rng.randrange(3000)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(40))
    docs, labels = [], []
    for i in range(700):
        toxic = int(i % 5 == 0)
        t = text() + (" markerword" if toxic and i % 10 == 0 else "")  # half of the toxic texts have no common word
        docs.append((i, t))
        labels.append((i, 1, toxic))
    docs += [(2000 + i, t) for i, t in docs[:300]]  # copies without labels
    docs += [(3000, None), (3001, ""), (3002, "123 !!"), (3003, "unknownone unknowntwo"), (None, docs[0][1]), (3004, docs[1][1] * 50)]
    docs += docs[:5]  # repeated rows
    labels += [(3005, 1, None), (None, 1, 1), (0, 1, 1)]
    rows = spark.createDataFrame([(*d, "x", 1.0, 0) for d in docs], "doc_id bigint, text string, evidence string, score double, toxic int")
    return docs, rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_copies_of_every_example_are_found_with_cosine_one(spark, tables):
    docs, rows, labels = tables
    model = op.learn(rows, labels)
    assert model.space.marks and len(model.space.words) > 2500
    texts = dict(docs[:700])
    of = {texts[i]: int(t) for i, t in zip(model.example_ids, model.labels, strict=True)}
    found = {r["doc_id"]: r for r in op.toxicity(rows, model).collect() if r["doc_id"] is not None}
    copies = [d for d, t in docs if d is not None and d >= 2000 and t in of]
    assert len(copies) > 150
    for d in copies:
        first = found[d]["evidence"][0]
        assert first["cosine"] == 1.0 and texts[first["doc_id"]] == texts[d - 2000]
        assert (found[d]["score"] >= 0.5) == bool(of[texts[d - 2000]])
    assert len({found[d]["score"] for d in (3000, 3001, 3002, 3003)}) == 1
    assert found[3004]["evidence"]


def brute_vector(text, space):
    tf = {}
    for w in op.WORDS.findall((text or "").lower()):
        for f in [space.words.get(w), *(space.marks.get(x) for x in op.features_of_word(w))]:
            if f is not None:
                tf[f] = tf.get(f, 0) + 1
    raw = {f: (1 + math.log(n)) * space.idf[f] for f, n in tf.items()}
    general, marks = ({f: w for f, w in raw.items() if (f < len(space.words)) == side} for side in (True, False))
    norm = lambda part: math.sqrt(sum(w * w for w in part.values())) or 1.0
    shares = (op.GENERAL, 1 - op.GENERAL) if general and marks else (1, 1)
    return {f: w / norm(part) * math.sqrt(share) for part, share in ((general, shares[0]), (marks, shares[1])) for f, w in part.items()}


def test_cosines_and_scores_equal_brute_force(spark, tables):
    docs, rows, labels = tables
    model = op.learn(rows, labels, per_label=200)
    df = {w: sum(w in set(op.WORDS.findall((t or "").lower())) for _, t in docs) for w in list(model.space.words)[:200]}
    for w, n in df.items():  # idf counts all documents
        assert model.space.idf[model.space.words[w]] == pytest.approx(math.log(1 + len(docs) / n))
    texts = dict(docs[:700])
    examples = [brute_vector(texts[i], model.space) for i in model.example_ids]
    got = {r["doc_id"]: r["score"] for r in op.toxicity(rows, model).collect()}
    for d, t in docs[::7]:
        v = brute_vector(t, model.space)
        cosines = [sum(w * e.get(f, 0.0) for f, w in v.items()) for e in examples]
        near = [i for i in sorted(range(len(cosines)), key=lambda i: -cosines[i]) if cosines[i] > 0][: model.k]
        strength = [cosines[i] ** 2 / (1 - min(cosines[i], 1) + op.NEAREST) for i in near]
        share = (sum(s * model.labels[i] for s, i in zip(strength, near, strict=True)) + model.prior) / (sum(strength) + 1)
        odds = math.log(min(max(share, 1e-4), 1 - 1e-4) / (1 - min(max(share, 1e-4), 1 - 1e-4)))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(model.slope * odds + model.shift))), abs=1e-6)


def test_words_without_dimension_do_not_displace_the_others(monkeypatch):
    words = {w: i for i, w in enumerate(("alpha", "markers", "zeta"))}
    space = op.Space(words, {"mark*": 3, "marke*": 4, "markers": 5}, np.array([1.0, 2, 3, 4, 5, 6]))
    known = op._Known(space)
    text = "alpha zeta markers mark marker " + " ".join(f"rare{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))
    once = op.vector(text, known)
    assert set(known) == {"alpha", "zeta", "markers", "marker"}
    monkeypatch.setattr(op, "CACHE", 2)  # emptied before every text: the numbers of a text stay valid
    for t in (text, "markers alpha", "marker zeta zeta", text, None, ""):
        ids, weights = op.vector(t, known)
        want = brute_vector(t, space)
        assert ids.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)])
    assert np.array_equal(once[1], op.vector(text, known)[1])


def test_block_maxima_skip_no_neighbour():
    rng = np.random.default_rng(5)
    for common in (0.0, 0.1, 1.0):
        dense = rng.random((400, 60)) * (rng.random((400, 60)) < rng.random(60) * 0.6)
        dense[:, 0] += 0.01
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        sparse = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
        index = op.BlockMaxIndex(sparse, 60, common)
        for q in range(0, 400, 13):
            near, cosines = index.nearest(*sparse[q], 10)
            assert np.allclose(cosines, np.sort(dense @ dense[q])[::-1][:10]) and np.allclose(cosines, dense[near] @ dense[q])
    assert zlib.crc32(b"1") % 5 != 0
