"""Chunking: hand-written golden cases, and properties on random input."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.functions import text as T
from inkwell.functions.text import token_count
from inkwell.operators import chunking as C
from inkwell.session import table


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", F.transform(C.sentence_spans(F.col("t")), lambda s: s["text"]).alias("s")).collect()
    return [r.s for r in sorted(rows, key=lambda r: r.i)]


def test_sentences_golden(spark):
    cases = {
        "": [],
        "One. Two! Three?": ["One.", "Two!", "Three?"],
        "No end here": ["No end here"],
        "wrapped\nline. next": ["wrapped line.", "next"],
        "first block\n\nsecond block": ["first block", "second block"],
        "v1.2 stays whole. Yes": ["v1.2 stays whole.", "Yes"],
        "语义。检索！": ["语义。", "检索！"],
        "half；rest": ["half；", "rest"],
        " \n \n ": [],
    }
    assert spans_of(spark, list(cases)) == list(cases.values())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    alphabet = ["word", "a.b", "x!", "语义", "；", "end.", "? ", "\n", "\n\n", " ", " ", "long/path", "!", "."]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 160))) for _ in range(150)]


def test_sentences_keep_every_character_in_order(spark, texts):
    for text, found in zip(texts, spans_of(spark, texts), strict=True):
        assert "".join("".join(found).split()) == "".join(text.split())
        assert all(s and s == s.strip() for s in found)


def test_pack_golden():
    assert C.pack_sizes([], [], 40) == []
    assert C.pack_sizes([0, 0, 0], [20, 20, 20], 40) == [(0, 1), (2, 2)]
    assert C.pack_sizes([0, 0, 0], [20, 20, 20], 40, 20) == [(0, 1), (1, 2)]
    assert C.pack_sizes([0, 1], [5, 5], 40) == [(0, 0), (1, 1)]
    assert C.pack_sizes([0, 0], [16, 16], 8) == [(0, 1)]  # a budget is at least 32


def test_pack_properties():
    rnd = random.Random(5)
    for _ in range(300):
        n, budget, overlap = rnd.randint(0, 40), rnd.randint(32, 120), rnd.randint(0, 60)
        sizes = [min(rnd.randint(1, 60), budget) for _ in range(n)]
        owners = sorted(rnd.randint(0, 3) for _ in range(n))
        groups = C.pack_sizes(owners, sizes, budget, overlap)
        kept = min(overlap, budget // 2)
        assert {i for a, b in groups for i in range(a, b + 1)} == set(range(n))
        for a, b in groups:
            assert owners[a] == owners[b]
        for (a, b), (c, d) in zip(groups, groups[1:], strict=False):
            fresh = b + 1
            assert d >= fresh and c <= fresh
            if owners[fresh] != owners[b]:
                assert c == fresh
                continue
            assert sum(sizes[a : fresh + 1]) > budget, "the next item would still have fitted"
            tail = sizes[c:fresh]
            if kept == 0:
                assert not tail
            else:
                assert len(tail) == 1 or sum(tail) <= kept
                assert c == a or sum(sizes[c - 1 : fresh]) > kept, "a longer tail would have fitted"


def test_two_levels_nest_and_count(spark, texts):
    settings = Settings(parent_tokens=60, child_tokens=32, child_overlap_tokens=0)
    rows = [(str(i), "T", "note", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "asset_id string, title string, asset_type string, content string")
    out = C.chunk_documents(df, settings).withColumn("again", token_count(F.col("content"))).orderBy("asset_id", "chunk_id").collect()
    squeeze = lambda found: "".join("".join(r.content.split()) for r in found)
    for asset, _, _, text in rows:
        levels = {level: [r for r in out if r.asset_id == asset and r.chunk_level == level] for level in ("parent", "child")}
        assert squeeze(levels["parent"]) == squeeze(levels["child"]) == "".join(text.split())
    assert all(r.again == r.token_count <= (60 if r.chunk_level == "parent" else 32) for r in out)


OUTLINE = """lead line

# Top
Alpha here. Beta follows?
<!-- page:3 -->
On three.
## Sub A
<!-- page:4 -->
four.
### Deep
deep body
## Sub B
x
#NoSpace is text
# Other
"""


def test_sections_paths_and_pages(spark):
    df = spark.createDataFrame([(1, OUTLINE), (2, "# Only heading")], "id int, content string")
    rows = C.section_rows(df).orderBy("id", "section_no").collect()
    got = [(r.heading, r.page_start, r.page_end) for r in rows if r.id == 1]
    assert got == [
        ("正文", 0, 0),
        ("Top", 3, 3),
        ("Top / Sub A", 4, 4),
        ("Top / Sub A / Deep", 4, 4),
        ("Top / Sub B", 4, 4),
    ]
    assert [(r.heading, r.body) for r in rows if r.id == 2] == [("正文", "# Only heading")]


def test_chunks_of_whole_documents_keep_all_tokens(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("asset_id"), F.lit("t").alias("title"), F.lit("n").alias("asset_type"), F.col("text").alias("content")
    )
    parents = C.chunk_documents(docs).where("chunk_level = 'parent'").groupBy("asset_id").agg(F.sum("token_count").alias("n"))
    have = {r.asset_id: r.n for r in parents.collect()}
    for r in docs.select("asset_id", token_count(F.col("content")).alias("n")).collect():
        assert have.get(r.asset_id, 0) == r.n


def test_quick_patterns_equal_the_plain_ones(spark):
    """Sentences, token counts and line breaks of random texts over all special characters; null and empty stay what they are."""
    rng = random.Random(17)
    letters = [*"aZ9_./-\xdf\xf1\u8bed\u3002\uff01\uff1f!?\uff1b;,.\xa7\U0001f600", *T.WHITESPACE, "ab", ". ", "! ", "\n\n"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(1500)] + ["", "."]
    plain = C.SENTENCE.replace(r"(?!\w)", "")
    assert plain != C.SENTENCE
    breaks = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    every = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    for r in df.select(
        "t", every(C.SENTENCE).alias("quick"), every(plain).alias("plain"), T.token_count(F.col("t")).alias("n"), F.size(T.rough_tokens(F.col("t"))).alias("m"),
        every(T.LATIN_RUN).alias("latin"), every(T.LATIN_TOKEN).alias("listed"),
        F.regexp_replace("t", C.EXOTIC_BREAKS, "\n").alias("lines"), F.translate("t", breaks, "\n" * len(breaks)).alias("translated"),
    ).collect():
        assert r["quick"] == r["plain"] and r["latin"] == r["listed"] and r["lines"] == r["translated"], repr(r["t"])
        assert r["n"] == r["m"] or r["t"] is None


def test_a_long_sentence_is_cut_into_tokens_once(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    span = F.struct(F.col("t").alias("text"), F.lit(0).alias("page"), F.lit(5000).alias("size"))
    cut = spark.createDataFrame([(text,)], "t string").select(C.hard_split(span, 480).alias("parts"))
    assert "slice(regexp_extract_all" not in cut._jdf.queryExecution().analyzed().toString()
    parts = cut.first()["parts"]
    assert [p["size"] for p in parts] == [480] * 10 + [200] and " ".join(p["text"] for p in parts) == text
