"""The pipeline stage by stage on a small folder: every stage is judged on its own input by plain Python."""

import os
import random
import re

import pytest

import corpus_pipeline
from inkwell.llm.common import new_path, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(rng, n):
    stems = ["lor", "em", "ip", "sum", "dol", "or", "sit", "am", "con", "sec", "te", "tur"]
    return " ".join("".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    docs = [(i, text_of(rng, rng.randrange(20, 90)), "en", f"s{i % 3}") for i in range(240)]
    items = [(i, text_of(rng, 25)) for i in range(5)]
    docs += [(300 + i, docs[i][1].upper() if i % 2 else docs[i][1], "en", "s0") for i in range(10)]  # exact copies
    for i in range(10, 20):  # near copies
        w = docs[i][1].split() * 2
        docs[i] = (i, " ".join(w), "en", "s1")
        docs.append((400 + i, " ".join([*w, "added"]), "en", "s2"))
    docs += [(500 + i, f"{text_of(rng, 30)} {items[i][1]} {text_of(rng, 30)}", "en", "s0") for i in range(5)]
    docs += [(600 + i, "".join(rng.choice("~#%&§=|") for _ in range(300)), "en", "s1") for i in range(5)]
    docs += [(700, None, "en", None), (701, "", None, "s0")]
    tables = {
        "documents": spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": spark.createDataFrame([(r[0], int(r[0] < 600), 0) for r in docs], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def near_kept(rows):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in sets if find(d) == d}


def test_stages_equal_brute_force_and_working_tables_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = step(spark, docs, folder)
        path = new_path(spark, "test-result")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, {r["doc_id"] for r in docs.collect()})
        if name != "mix":
            assert docs.columns == columns
    before, after = seen["quality"]
    assert set(range(600, 605)).isdisjoint(after) and set(range(240)) <= after
    before, after = seen["exact_dedup"]
    groups = {}
    for d, t in before.items():
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), []).append(d)
    assert after == {max(g) for g in groups.values()}
    before, after = seen["near_dedup"]
    assert after == near_kept(list(before.items()))
    before, after = seen["decontaminate"]
    assert before.keys() - after == set(range(500, 505))
    before, after = seen["mix"]
    assert before.keys() == after
    sizes = {d: len(WORD.findall(t or "")) for d, t in before.items()}
    rows = docs.collect()
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in rows)


def test_run_equals_the_stages(spark, folder):
    ids = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect())
    root = shared_dir(spark).removeprefix("file:")
    results = [f for f in os.listdir(root) if f.startswith("pipeline-")]
    assert [f.split("-")[1] for f in results] == ["decontaminate"]  # earlier results are deleted
    assert len(ids) == len(set(ids)) and set(range(500, 505)).isdisjoint(ids) and set(range(240)) - set(range(10)) <= set(ids)
