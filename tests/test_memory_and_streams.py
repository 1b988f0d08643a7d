import html
import random
import re
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.functions import text as T
from inkwell.operators import memory as M
from inkwell.operators.segments import running_before
from inkwell.plans import jobs
from inkwell.sources import ingest, store
from inkwell.streaming import feeds


def working(spark, sizes, session="s1"):
    rows = [("p", session, i, 0, f"k{i}", " ".join(["w"] * n), 0.5, "query", f"id{i}") for i, n in enumerate(sizes, start=1)]
    return spark.createDataFrame(
        rows, "project_id string, session_id string, sequence_id int, ordinal int, memory_key string, content string, importance double, kind string, id string"
    )


def greedy(sizes, threshold):
    if sum(sizes) <= threshold:
        return set(range(len(sizes)))
    taken, used = set(), 0
    for i in reversed(range(len(sizes))):
        if taken and used + sizes[i] > threshold:
            continue
        taken.add(i)
        used += sizes[i]
        if used >= threshold:
            break
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_context_pick_matches_fold(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, 30) for _ in range(60)]
    rows = M.context_pick(working(spark, sizes), Settings(working_token_threshold=100)).collect()
    tokens = {r.sequence_id - 1: r.tokens for r in M.with_tokens(working(spark, sizes)).collect()}
    assert {r.sequence_id - 1 for r in rows} == greedy([tokens[i] for i in range(len(sizes))], 100)


def test_compaction_is_a_prefix(spark):
    settings = Settings(working_token_threshold=40, compaction_ratio=0.75)
    items = working(spark, [8] * 8)
    picked = M.compaction_pick(items, settings).orderBy("sequence_id").collect()
    per = M.with_tokens(items).first().tokens
    assert [r.sequence_id for r in picked] == list(range(1, -(-30 // per) + 1))
    assert M.compaction_pick(items, Settings(working_token_threshold=10_000)).isEmpty()


def test_running_before_in_segments(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("o"), (F.col("id") % 3 + 1).alias("v"))
    rows = running_before(df, ["k"], "o", [], F.col("v"), "before", size=7).orderBy("o").collect()
    total = 0
    for r in rows:
        assert r.before == total
        total += r.v


def test_compaction_keeps_rows_without_summary(spark):
    settings = Settings(working_token_threshold=40)
    both = working(spark, [8] * 8).unionByName(working(spark, [8] * 8, "s2"))
    reply = '```json\n{"episodic_memories":[{"summary":"did it","importance":7}],"semantic_memories":[{"statement":"a fact","fact_type":"x"}]}\n```'
    summaries = spark.createDataFrame([("p", "s1", reply), ("p", "s2", '{"episodic_memories":[]}')], "project_id string, session_id string, summary_json string")
    out = jobs.compact_memory(both, summaries, settings)
    assert [(r.event_type, r.summary, r.importance) for r in out["episodic"].collect()] == [("working_memory_summary", "did it", 1.0)]
    assert [(r.fact_type, r.memory_key) for r in out["drafts"].collect()] == [("fact", "fact_a_fact")]
    left = {r.session_id: r.n for r in out["working"].groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert left["s2"] == 8 and left["s1"] < 8


def test_upsert_keeps_first_id_and_latest_values(spark):
    schema = (
        "project_id string, session_id string, sequence_id bigint, position int, fact_type string, memory_key string, statement string, "
        "subject string, predicate string, object string, importance double, metadata string, updated_at timestamp"
    )
    t = datetime(2024, 1, 1)
    row = lambda text, day: ("p", "s", day, 0, "fact", "k", text, "x", "y", "z", 0.5, "{}", t + timedelta(days=day))
    first = M.upsert_facts(spark.createDataFrame([row("old", 1)], schema))
    again = M.upsert_facts(spark.createDataFrame([row("new", 3), row("mid", 2)], schema), first).collect()
    assert len(again) == 1 and again[0].statement == "new" and again[0].id == first.first().id


def test_store_upsert_delete_and_replay(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "op string, asset_id string, title string, asset_type string, content string, version int"
    batch = spark.createDataFrame([("upsert", "a", "A", "n", "one. two.", 1), ("upsert", "b", "B", "n", "three.", 1)], schema)
    store.apply_asset_changes(batch, path)
    store.apply_asset_changes(batch, path)
    assert {r.asset_id for r in store.read_chunks(spark, path).collect()} == {"a", "b"} and store.read_chunks(spark, path).count() == 4
    store.apply_asset_changes(spark.createDataFrame([("delete", "a", "", "", "", 2), ("upsert", "b", "B", "n", "four five.", 2)], schema), path)
    rows = store.read_chunks(spark, path).collect()
    assert {(r.asset_id, r.content) for r in rows} == {("b", "four five.")}


def test_store_versions_and_compaction(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "op string, asset_id string, title string, asset_type string, content string, version int"

    def change(op, asset, text, version):
        store.apply_asset_changes(spark.createDataFrame([(op, asset, "A", "n", text, version)], schema), path)

    def stored(place=path):
        return {(r.asset_id, r.content) for r in store.read_chunks(spark, place).collect()}

    change("upsert", "a", "new.", 5)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    change("upsert", "a", "old.", 1)
    change("upsert", "b", "other.", 1)
    assert stored() == {("a", "new."), ("b", "other.")}
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    store.delete_assets(spark.createDataFrame([("a",)], "asset_id string"), path)
    change("upsert", "a", "late.", 5)
    change("upsert", "b", "", 2)
    assert stored() == set()
    change("upsert", "a", "back.", 7)
    store.compact_chunks(spark, path, str(tmp_path / "small"))
    path = str(tmp_path / "small")
    change("upsert", "b", "late again.", 1)
    assert stored(path) == {("a", "back.")}


def test_facts_follow_their_own_time(spark, tmp_path):
    path, t = str(tmp_path / "facts"), datetime(2024, 1, 1)
    schema = (
        "project_id string, session_id string, sequence_id bigint, position int, fact_type string, memory_key string, statement string, "
        "subject string, predicate string, object string, importance double, metadata string, updated_at timestamp"
    )
    row = lambda project, text, day: (project, "s", day, 0, "fact", "k", text, "x", "y", "z", 0.5, "{}", t + timedelta(days=day))
    for project, text, day in (("p", "new", 3), ("p", "late", 1), ("q", "gone", 2)):
        store.apply_fact_drafts(spark.createDataFrame([row(project, text, day)], schema), path)
    store.delete_project_facts(spark.createDataFrame([("q",)], "project_id string"), path, F.lit(t + timedelta(days=2)))
    read = lambda place: {(r.project_id, r.statement) for r in store.read_facts(spark, place).collect()}
    assert read(path) == {("p", "new")}
    small = str(tmp_path / "small")
    store.compact_facts(spark, path, small)
    store.apply_fact_drafts(spark.createDataFrame([row("q", "still gone", 1), row("q", "again", 4)], schema), small)
    assert read(small) == {("p", "new"), ("q", "again")}


def test_ingest_real_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "notes.md").write_text("---\na: b\n---\n# Title\n\n\n\nbody", encoding="utf-8")
    (tmp_path / "in" / "gb.txt").write_bytes("语义通信".encode("gb18030"))
    (tmp_path / "in" / "bad.bin").write_bytes(b"x")
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    assets, rejected = jobs.prepare_documents(spark, str(tmp_path / "in"))
    got = {r.title: (r.asset_type, r.content) for r in assets.collect()}
    assert got["notes"] == ("markdown", "# Title\n\n来源文件：notes.md\n\nbody")
    assert got["gb"] == ("note", "# gb\n\n来源文件：gb.txt\n\n语义通信")
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in rejected.collect()} == {"bad.bin": "unsupported_suffix"}
    # the folder scan skips empty files; other sources may deliver them
    empty = spark.createDataFrame([("e.txt", 0, bytearray()), ("b.txt", 1, bytearray(b"\xff"))], "path string, length long, content binary")
    assert sorted(r.reason for r in ingest.parse_files(empty)[1].collect()) == ["empty_file", "unknown_encoding"]


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "语"), (2, "b")], "id bigint, text string")
    ingest.write_jsonl(rows, str(tmp_path / "r"))
    assert sorted(map(tuple, ingest.read_jsonl(spark, str(tmp_path / "r"), "id bigint, text string").collect())) == [(1, "语"), (2, "b")]


def _stream(spark, tmp_path, rows, schema, files, build, name, run=feeds.run_available):
    """Write rows as several files, one file per trigger, and run the stream over them."""
    src = tmp_path / f"{name}-src"
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    frame = build(stream)
    run(frame, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-chk"))
    return spark.read.schema(frame.schema).parquet(str(tmp_path / f"{name}-out")).collect()


@pytest.mark.parametrize("files", [1, 3, 6])
def test_guard_judges_in_order_of_arrival(spark, tmp_path, files):
    rows = [("s", n, i) for i, n in enumerate([2, 1, 2, 4, 3])] + [("t", 2, 9)]
    got = _stream(spark, tmp_path, rows, "session_id string, sequence_id bigint, arrived_at int", files, feeds.guard_sequences, f"guard{files}")
    assert sorted((r.session_id, r.sequence_id, r.expected, r.accepted) for r in got) == [
        ("s", 1, 1, True), ("s", 2, 1, False), ("s", 2, 2, True), ("s", 3, 3, True), ("s", 4, 3, False), ("t", 2, 1, False)
    ]


@pytest.mark.parametrize("files", [1, 4, 17])
def test_stream_compaction_does_not_depend_on_triggers(spark, tmp_path, files):
    rows = [("s", i, j, f"{i}-{j}", 10) for i in range(1, 9) for j in (0, 1)] + [("s", 9, 0, "9-0", 90)]
    build = lambda s: feeds.compact_sessions(s, Settings(working_token_threshold=45))
    got = _stream(spark, tmp_path, rows, "session_id string, sequence_id bigint, ordinal int, id string, tokens int", files, build, f"comp{files}")
    assert sorted((r.trigger_sequence_id, r.compacted_tokens, r.total_tokens, tuple(r.item_ids)) for r in got) == [
        (3, 40, 60, ("1-0", "1-1", "2-0", "2-1")),
        (5, 40, 60, ("3-0", "3-1", "4-0", "4-1")),
        (7, 40, 60, ("5-0", "5-1", "6-0", "6-1")),
    ]


def test_uploads_finish_once(spark, tmp_path):
    rows = [("u", 0, 3), ("u", 2, 3), ("u", 2, 3), ("u", 1, 3), ("u", 1, 3), ("v", 0, 2), ("v", 2, 2), ("v", -1, 2)]
    got = _stream(spark, tmp_path, rows, "upload_id string, part_index int, total_chunks int", 6, feeds.track_uploads, "up", feeds.run_updates)
    assert [(r.upload_id, r.total_chunks) for r in got] == [("u", 3)]


def test_clean_html(spark):
    df = spark.createDataFrame([("a &amp; b\n\n&lt;c&gt;",), ("plain  text",), (None,)], "t string")
    assert [r[0] for r in df.select(ingest.clean_html(F.col("t"))).collect()] == ["a & b <c>", "plain text", None]


def test_clean_html_equals_unescape_and_ships_only_references(spark):
    rng = random.Random(5)
    pieces = ["&amp;", "&amp", "&lt", "&notit;", "&nosuch;", "&#65;", "&#x41", "&#0;", "&#xD800;", "&#9999999;", "&", ";", "#", "&&gt;", "a", "é", "😀", " ", "\n", "&NewLine;", "&fjlig;"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(1500)] + [None, "", "&" * 40, "&" + "x" * 50 + ";"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r[0]: r[1] for r in df.select("i", ingest.clean_html(F.col("t"))).collect()}
    space = re.compile(f"{T.WS_CLASS}+")
    assert got == {i: t if t is None else space.sub(" ", html.unescape(t)).strip(" ") for i, t in enumerate(texts)}
    seen = ingest._decoded.func(pa.array([["&amp;"], None, [], ["&lt", "&amp;"]]))
    assert seen.to_pylist() == [["&"], [], [], ["<", "&"]]


def test_memory_context_blocks(spark):
    now = datetime(2024, 6, 1)
    runs = spark.createDataFrame(
        [("p", "s", 1, "how are alpha results", "alpha works well. more", now)],
        "project_id string, session_id string, sequence_id int, user_query string, answer string, updated_at timestamp",
    )
    asked = spark.createDataFrame(
        [(1, "p", "s", "alpha again"), (2, "q", "t", "nothing here")], "query_id int, project_id string, session_id string, query string"
    )
    facts = M.upsert_facts(M.fact_drafts(runs))
    out = M.memory_context(asked, M.working_rows(runs), M.episodic_rows(runs), facts, runs, F.lit(now))
    rows = {r.query_id: r for r in out.collect()}
    assert rows[1].session_context == "- 用户#1: how are alpha results\n  助手#1: alpha works well. more"
    assert rows[1].working_context == "- turn_1_query: how are alpha results\n- turn_1_answer: alpha works well. more"
    assert rows[1].episodic_context == "- [research_run] how are alpha results -> alpha works well. more"
    assert "- fact.answer_alpha_works_well_more: alpha works well. more" in rows[1].semantic_context
    assert rows[2].memory_context.count("yet") == 3
