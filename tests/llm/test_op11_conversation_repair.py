"""Conversation repair against an exhaustive search, with nulls, ties, repeated rows, clashing columns and long conversations."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from inkwell.llm import op11_conversation_repair as op

GRAMMAR = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows, entry=op.START, goals=op.ACCEPTING):
    """Uniform-cost search over (cost, audit): no bounds, no dominance but that of settled nodes."""
    heap, settled = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(rows) and state in goals:
            return cost, audit, state
        heapq.heappush(heap, (cost + 2, audit + "I", i, op.AFTER[state]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault not in "bd":
                paid = cost + (fault == "t")
                heapq.heappush(heap, (paid + 2, audit + "R", i + 1, op.AFTER[state]))
                if initial == op.WANTS[state]:
                    heapq.heappush(heap, (paid, audit + "K", i + 1, op.AFTER[state]))
                if initial == "s" and state == op.START:
                    heapq.heappush(heap, (paid, audit + "K", i + 1, op.SYSTEM))
    return None


def brute(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: result}, by plain Python over whole conversations."""
    space = lambda v: " " if v is None else str(v)
    groups = {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        act = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        if act:
            group += [(turn, "user" if act == 4 else role, text)] * (1 + (act == 3))
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faulted = set(), []
        for _, role, text in group:
            core = text.rstrip(WHITE)
            fault = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-"
            seen.add((role, text))
            faulted.append((role[:1] or "x", fault))
        cost, audit, _ = cheapest(faulted)
        lines, i, made = [], 0, ""
        for op_ in audit:
            wanted = "user" if made in ("", "s") or made[-1] == "a" else "assistant"
            if op_ != "I":
                _, role, text = group[i]
                i += 1
            if op_ != "D":
                lines.append(f"{role}:{text}" if op_ == "K" else f"{wanted}:{text if op_ == 'R' else ''}")
                made += lines[-1][0]
        assert GRAMMAR.fullmatch(made)
        turns = [t for t, *_ in group if t is not None]
        count = lambda f: sum(x[1] == f for x in faulted)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulted))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, digest)
    return out


def test_search_equals_exhaustive_search():
    rng = random.Random(11)
    for n in [0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20, 40, 90] * 12:
        rows = [(rng.choice("suuuaaax"), rng.choice("bdt------")) for _ in range(n)]
        assert op.best_repairs(rows, op.START, op.ACCEPTING) == cheapest(rows)
        for entry, goal in itertools.product(range(4), repeat=2):
            want = cheapest(rows, entry, (goal,)) if goal in op.REACHED[entry] else None
            assert op.best_repairs(rows, entry, (goal,)) == want


def test_long_searches_end_quickly():
    rng = random.Random(3)
    for weights in ("ua", "uuuuuuaa", "suax"):
        rows = [(rng.choice(weights), rng.choice("bdt---")) for _ in range(op.PIECE)]
        assert op.piece_table(rows, False)


def conversations(spark, rows):
    """Four more columns clash with names used inside the operator."""
    return spark.createDataFrame(
        [(*r, 1, "x", "y", "z") for r in rows],
        "conv_id bigint, turn bigint, role string, text string, uid int, fault string, audit string, kind string",
    )


def found(spark, rows, piece):
    staged, heads = op.repairs(conversations(spark, rows).repartition(5), piece)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in op.with_digest(staged, heads).collect()}
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv_id"]: (*(r[c] for c in columns), digests[r["conv_id"]]) for r in heads.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = ["Hello.", "Why?", "no end", "", " \t\n", "Hello. ", "ends\x0b!\r", None, "é…", "x" * 50_000 + ".", "two\nlines."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown", "é"]
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            out.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
    out += [(70, None, "user", "a."), (70, None, "assistant", "b."), (71, None, None, None)]
    out += [(72, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(900)]
    out += [(73, t // 40, rng.choice(roles), rng.choice(texts)) for t in range(300)]  # many rows of one turn
    out += [r for r in out if r[0] == 5]  # repeated rows
    gone = next(k for k in itertools.count(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*out, (gone, 0, "user", "dropped")]


@pytest.mark.parametrize("piece", [7, op.PIECE])
def test_repairs_equal_brute_force(spark, rows, piece):
    got, want = found(spark, rows, piece), brute(rows)
    assert got.keys() == want.keys()
    assert {k: got[k] for k in got if got[k] != want[k]} == {}
    assert want[rows[-1][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_rows_of_the_repair_and_empty_tables(spark, rows):
    staged, heads = op.repairs(conversations(spark, rows[:40]))
    repaired = {}
    for r in op.repaired_rows(staged, heads).orderBy("conv_id", "place").collect():
        repaired.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in op.with_digest(staged, heads).collect():
        assert hashlib.sha256("\n".join(repaired.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
    staged, heads = op.repairs(conversations(spark, rows[:1]).limit(0))
    assert heads.count() == 0 and op.with_digest(staged, heads).count() == 0
