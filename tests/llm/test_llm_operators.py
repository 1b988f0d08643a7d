"""The training-data operators against brute force and planted cases, with nulls, empty, repeated and clashing input."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from inkwell.llm import (
    op1_quality, op2_mixing, op3_html, op4_toxicity, op5_licenses, op6_decontaminate, op7_minhash, op8_warc, op9_pii, op10_exact_dedup,
)
from inkwell.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, row string, digest string"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); three more columns clash with names used inside the operators."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 120)), rng.choice(["en", None]), rng.choice(["a", "b", None, "é"])) for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \t\n", "en", "b"), (None, "same text", "en", "a")]
    rows += [(103, rows[0][1].upper(), "en", "a"), (104, rows[0][1], "en", "b"), (104, rows[0][1], "en", "b"), (105, "one", "en", "a")]
    for k in range(12):
        t = rows[k][1].split()
        t[len(t) // 2] = "changed"
        rows.append((200 + k, " ".join(t), "en", "a"))
    return rows


def test_exact_dedup_with_weak_digests_and_small_triggers(spark, mixed_rows):
    docs = documents(spark, mixed_rows).repartition(5)
    weak = lambda text: op10_exact_dedup.sha256(text.substr(1, 1))
    groups = {}
    for d, t, *_ in mixed_rows:
        groups.setdefault((t or "").lower(), []).append(d)
    want = sorted((str(d), str(max((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for d in g)
    for digest, files in ((op10_exact_dedup.sha256, 1), (weak, 2)):
        _, decisions = op10_exact_dedup.decide(docs, digest, files)
        got = decisions.collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
    assert op10_exact_dedup.deduplicated(docs).columns == docs.columns
    assert op10_exact_dedup.decide(docs.limit(0))[1].count() == 0


def brute_components(rows, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize("small", [64, 2])
def test_near_duplicates_equal_brute_force(spark, mixed_rows, monkeypatch, small):
    """With ``small`` at 2 the buckets go through the matrix products."""
    monkeypatch.setattr(op7_minhash, "SMALL", small)
    monkeypatch.setattr(op7_minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = words(rng, 80).split()
    rows = list(mixed_rows)
    for k in range(40):
        t = list(base)
        for i in rng.sample(range(80), rng.randrange(1, 4)):
            t[i] = f"edit{k}"
        rows.append((1000 + k, " ".join(t), "en", "a"))
    _, decisions = op7_minhash.near_duplicates(documents(spark, rows).repartition(3))
    got = sorted((str(r["doc_id"]), r["n"], str(r["component_id"])) for r in decisions.collect())
    assert got == brute_components(rows)


def test_near_duplicates_of_an_empty_table(spark, mixed_rows):
    docs = documents(spark, mixed_rows)
    assert op7_minhash.deduplicated(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 300)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 300: 200}


def test_mix_meets_targets_and_repeats(spark, mixed_rows):
    docs = documents(spark, mixed_rows)
    first = sorted(map(str, op2_mixing.taken(docs, block_words=16).collect()))
    assert first == sorted(map(str, op2_mixing.taken(docs.repartition(4), block_words=16).collect()))
    rows = op2_mixing.taken(docs, block_words=16).collect()
    assert len(rows) == len(mixed_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and free:
        total, left = sum(weight[s] for s in free), 0.0
        for s in sorted(free, key=order.index):
            target[s] += rest * weight[s] / total
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        free = {s for s in free if target[s] < 2 * sizes[s]}
        rest = left
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert op2_mixing.taken(docs.limit(0)).count() == 0


def test_pii_spans():
    text = "mail a.b@c.example.com_x@y.org ip 1.2.3.4.5 999.1.1.1 card 4111 1111 1111 1111, tel +1 (434) 555-2368 é DE89 3704 0044 0532 0130 00"
    spans = [(s["kind"], s["value"]) for s in op9_pii.spans_of(text)]
    assert ("email", "a.b@c.example.com") in spans and ("email", "_x@y.org") in spans
    assert ("ip", "1.2.3.4") in spans and not any(v.startswith("999") for _, v in spans)
    assert ("card", "4111 1111 1111 1111") in spans and ("phone", "+1 (434) 555-2368") in spans
    assert ("iban", "DE89 3704 0044 0532 0130 00") in spans
    assert op9_pii.spans_of(None) == [] and op9_pii.spans_of("") == []
    assert op9_pii.spans_of("a" * 300_000 + " 1" + "2" * 100_000) == []


def test_pii_ibans_before_other_words():
    for iban in ("AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "AT611904300234573201"):
        for rest in (" BIC BKAUATWW", " EUR 500", " 2024", ", paid", ""):
            found = [(s["value"], s["start"]) for s in op9_pii.spans_of(f"IBAN {iban}{rest}") if s["kind"] == "iban"]
            assert found == [(iban, 5)], (iban, rest)
    both = "XX12 3456 7890 AT61 1904 3002 3457 3201 BE68 5390 0754 7034 EUR"
    assert [s["value"] for s in op9_pii.spans_of(both) if s["kind"] == "iban"] == ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034"]
    assert not [s for s in op9_pii.spans_of("IBAN AT61 1904 3002 3457 3202 BIC BKAUATWW") if s["kind"] == "iban"]


def test_pii_base_equals_plain_patterns():
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = lambda v: re.sub("[^0-9]", "", v)
    valid = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 13 <= len(digits(v)) <= 19 and op9_pii.luhn(digits(v)),
        "phone": lambda v: 9 <= len(digits(v)) <= 15,
    }
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab1234567890.@+- ()_%é") for _ in range(rng.randrange(60)))
        want = [(k, m.start(), m.end()) for k in plain for m in re.finditer(plain[k], text) if valid[k](m[0])]
        got = [(s["kind"], s["start"], s["end"]) for s in op9_pii.spans_of(text) if s["kind"] in op9_pii.BASE]
        assert got == want, text


def test_pii_frame(spark, mixed_rows):
    docs = documents(spark, mixed_rows + [(900, "write to me@site.org now", "en", "a")])
    found = {r["doc_id"]: r["spans"] for r in op9_pii.find_pii(docs).collect()}
    assert [s["value"] for s in found[900]] == ["me@site.org"] and found[100] == []
    assert {r["doc_id"]: r["text"] for r in op9_pii.redacted(docs).collect()}[900] == "write to <email> now"


ARTICLE = "<article><h1>T&amp;C</h1><p>shared&nbsp;passage</p><p><b>body {0}<br><p>more</article>"
MENU = '<nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav><div class="box">Our site</div>'


def test_html_articles_and_templates(spark):
    pages = [(i, f"https://h.org/{i}", f"<html><script>a='<p>'</script>{MENU}{ARTICLE.format(i)}<footer>f</footer>") for i in range(8)]
    pages += [(20 + i, f"http://plain.org/{i}", f"<body>{MENU}<div>only here {i}<form>search</form></div><!-- c") for i in range(8)]
    pages += [(50, None, None), (51, "http://h.org/e", ""), (52, "x", "no <markup & 1 < 2"), (52, "x", "no <markup & 1 < 2")]
    df = spark.createDataFrame([(*p, "u", "h") for p in pages], "page_id bigint, url string, html string, uid string, host string")
    got = {r["page_id"]: r["text"] for r in op3_html.extract(df).collect()}
    assert got[3] == "T&C\nshared passage\nbody 3\nmore"
    assert got[24] == "only here 4"
    assert got[50] == "" and got[51] == "" and got[52].startswith("no")
    assert op3_html.extract(df).count() == len(pages) and op3_html.extract(df.limit(0)).count() == 0


def test_html_comments_and_adverts_inside_the_article():
    page = "<article><p>keep</p><div class='ad'>buy</div><aside>side</aside><section id=comments><p>nice</p></section><p hidden>x</p></article>"
    assert [t for t, _, _ in op3_html.parse(page)[2]] == ["keep"]


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    body = "<p>é " + "x" * 200
    rows = [(i, f"http://h/{i}\n", body if i % 3 == 0 else f"small{i % 2}") for i in range(40)] + [(50, None, None), (51, "u", "")]
    pages = spark.createDataFrame([(*r, "u") for r in rows], "page_id bigint, url string, html string, uid string")
    for compress in ("true", "false"):
        path = str(tmp_path / compress)
        pages.write.parquet(str(tmp_path / f"pages-{compress}"))
        op8_warc.write_pages(spark.read.parquet(str(tmp_path / f"pages-{compress}")), path, compress=compress, max_file_bytes="2000")
        full = op8_warc.read_warc(spark, path).collect()
        assert len(full) == len(rows)
        texts = {int(r["record_id"].split(":")[2]): bytes(r["payload"]).decode() for r in full if r["record_type"] == "response"}
        assert texts == {i: h or "" for i, _, h in rows if i % 3 or i in (0, 51) or i == 50}
        revisits = op8_warc.read_warc(spark, path, "none").where("record_type = 'revisit'")
        assert {r["refers_to"].split(":")[2] for r in revisits.collect()} == {"0"} and revisits.count() == 13
        assert op8_warc.read_warc(spark, path, "digest").where("target_uri = 'http://h/4'").first()["payload_sha256"] == hashlib.sha256(b"small0").hexdigest()
    op8_warc.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert op8_warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_of_another_writer(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <{}>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    plain = [record.format("metadata" if i % 2 else "resource", i).encode() for i in range(6)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in plain))
    (tmp_path / "b.warc").write_bytes(b"".join(plain))
    got = op8_warc.read_warc(spark, str(tmp_path)).where("record_type = 'resource'").collect()
    assert len(got) == 6 and all(bytes(r["payload"]) == b"hello" for r in got)


def test_licences_by_sentence_rules(spark):
    s = op5_licenses.SENTENCES
    mit = f"Copyright 2020 X\n\n{s['mit-grant']}:\n\n{s['mit-notice']}.\n\n{s['mit-warranty']}. {s['mit-liability']}."
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    for text in (mit, wrapped):
        assert [(m["licence"], m["sentences"]) for m in op5_licenses.licences(text)] == [("MIT", 4)]
    apart = f"{s['mit-grant']}. " + "Other words here. " * 9 + s["mit-notice"] + "."
    assert op5_licenses.licences(apart) == []
    notice = "some text. more\nLicensed under the Apache License, Version 2.0.\nand on"
    match = op5_licenses.licences(notice)[0]
    assert match["licence"] == "Apache-2.0" and notice[match["start"] : match["end"]].strip().startswith("Licensed under the Apache")
    assert op5_licenses.licences(None) == [] and op5_licenses.licences("") == []
    docs = documents(spark, [(1, notice, "en", "a"), (2, None, "en", "a")])
    assert {r["doc_id"]: len(r["matches"]) for r in op5_licenses.scan(docs).collect()} == {1: 1, 2: 0}


def test_leaks_exact_and_reparameterised(spark):
    rng = random.Random(4)
    filler = lambda: words(rng, 60, 5000)
    question = "A train with Anna leaves at 7 km from the old town and drives 30 km per hour until Anna has covered 7 km today"
    other = "the quick learner reads nine books about rivers and mountains before winter comes to the valley again"
    same = question.replace("Anna", "Bruno").replace("7 km", "12.5 miles").replace("30", "45")
    broken = "A train with Anna leaves at 8 km from one new city or walks 31 km each minute while Carl had counted 9 m twice"
    docs = documents(spark, [
        (1, f"{filler()}. {question}. {filler()}", "en", "a"), (2, f"{filler()}. {same}. {filler()}", "en", "a"),
        (3, f"{filler()}. {broken}. {filler()}", "en", "a"), (4, filler(), "en", "a"), (5, None, "en", "a"), (6, "", "en", "a"),
        (7, f"{filler()}\n{other.upper()}\n", "en", "a"),
    ])
    items = spark.createDataFrame([(1, question, "z"), (2, other, "z"), (3, None, "z"), (4, "too short", "z")], "item_id bigint, text string, uid string")
    _, found = op6_decontaminate.leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in found.collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 2)} and got[(1, 1)] == "exact"
    clean = op6_decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 6}
    assert op6_decontaminate.decontaminated(docs.limit(0), items).count() == 0
    assert op6_decontaminate.decontaminated(docs, items.limit(0)).count() == 7


def test_leaks_with_changed_tokens_at_every_offset(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"q{''.join(rng.choice('abcdefgh') for _ in range(9))}" for _ in range(n)]
    long, short, six = fresh(48), fresh(3), fresh(6)
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(six))], "item_id bigint, text string")
    rows, want = [], set()
    for every in (2, 5, 6, 8):
        for at in range(5):
            changed = [w if (j + 1) % every else fresh(1)[0] for j, w in enumerate(long)]
            rows.append((len(rows), " ".join(fresh(20 + at) + changed + fresh(9)), "en", "a"))
            want.add((rows[-1][0], 1))
    for at in range(5):
        rows.append((len(rows), " ".join(fresh(20 + at) + short + fresh(9) + six[:2] + ["other"] + six[3:] + fresh(3)), "en", "a"))
        want |= {(rows[-1][0], 2), (rows[-1][0], 3)}
    rows.append((len(rows), " ".join(fresh(20) + [w if j % 5 < 2 else fresh(1)[0] for j, w in enumerate(long[:30])] + long[:2] + short[:2]), "en", "a"))
    _, found = op6_decontaminate.leaks(documents(spark, rows), items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want - {(rows[-1][0], 2)}
    alone = op6_decontaminate.leaks(documents(spark, rows), items.where("item_id = 1"))[1]
    assert {(r["doc_id"], r["item_id"]) for r in alone.collect()} == {w for w in want if w[1] == 1}


def test_kneser_ney_sums_to_one_and_shards_agree(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(200)) for _ in range(20)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid bigint, text string")
    counted = frame.mapInArrow(op1_quality._count, "g string, c bigint").groupBy("g").agg({"c": "sum"}).toDF("g", "c")
    assert counted.agg({"c": "sum"}).first()[0] == 4000
    model = {r["g"]: (r["p"], r["back"]) for r in op1_quality.estimate(counted).collect()}
    alphabet = "abc "
    for h in ("ab", "a", "c a"):
        total = 0.0
        for w in alphabet:
            context, factor = h, 1.0
            while context + w not in model:
                factor *= model.get(context, (0, None))[1] or 1.0
                context = context[1:]
            total += factor * model[context + w][0]
        assert total == pytest.approx(1.0, abs=0.02)
    one = {r["uid"]: (r["chars"], r["total"]) for r in op1_quality.score(frame, *op1_quality.train(frame)).collect()}
    path, shards = op1_quality.train(frame, shard_rows=100)
    assert shards > 3
    many = {r["uid"]: (r["chars"], r["total"]) for r in op1_quality.score(frame, path, shards).collect()}
    assert all(one[u][0] == many[u][0] == 200 and one[u][1] == pytest.approx(many[u][1], rel=1e-5) for u in one)


def test_quality_rejects_junk_only(spark):
    rng = random.Random(6)
    stems = ["lor", "em", "ip", "sum", "dol", "or", "sit", "am"]
    text = lambda n: " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(rng.randrange(4, 80)), "en" if i % 2 else None, "a") for i in range(600)]
    junk = [(1000 + i, "".join(rng.choice("#%&!XQZ") for _ in range(200)), "en", "a") for i in range(5)]
    docs = documents(spark, rows + junk + [(2000, None, "en", "a"), (2001, "", None, "a")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)] + [(1000, 0, 0)], "doc_id bigint, quality int, toxic int")
    kept = op1_quality.accepted(docs, labels)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {r[0] for r in junk} and {2000, 2001} <= ids
    assert len(ids & set(range(600))) >= 595
    assert op1_quality.accepted(docs, labels.limit(0)).count() == len(rows) + 7
    assert op1_quality.accepted(docs.limit(0), labels).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    dense = rng.random((500, 30)) * (rng.random((500, 30)) < 0.15)
    dense[:, 0] += 0.01
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    sparse = [(tuple(np.flatnonzero(r).tolist()), tuple(r[np.flatnonzero(r)].tolist())) for r in dense]
    index = op4_toxicity.BlockMaxIndex(sparse, 30)
    for q in range(50):
        _, cosines = index.nearest(*sparse[q], 10)
        assert np.allclose(cosines, np.sort(dense @ dense[q])[::-1][:10])


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(500):
        t = words(rng, 40).split()
        if i % 4 == 0:
            t[rng.randrange(40)] = rng.choice(["badword", "uglyterm", "nastya", "nastyb"])
        rows.append((i, " ".join(t), "en", "a"))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = documents(spark, rows + [(900, None, "en", "a"), (901, "", "en", "a"), (None, "badword", "en", "a")])
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = op4_toxicity.learn(docs, labels)
    score = {r["doc_id"]: r["score"] for r in op4_toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((score[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert score[900] == score[901] < 0.5 < score[None]
    empty = op4_toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in op4_toxicity.toxicity(docs, empty).collect()} == {0.0}
    assert op4_toxicity.toxicity(docs.limit(0), model).count() == 0
