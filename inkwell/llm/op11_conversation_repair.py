"""Repair of conversation structure by depth-first branch-and-bound.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. Every row is kept, given another role or deleted,
and empty rows are inserted, at the least cost; of equally cheap repairs the ASCII-least audit wins.

The search. ``best_repairs`` walks a few hundred rows with an explicit stack. A node is (rows consumed, state of the
grammar); its dominance table keeps the best (cost, audit) that reached it, and worse prefixes are dropped. Suffix lower
bounds come from a relaxed grammar in which a system row may stand before any user row. A prefix whose cost plus bound
cannot beat the incumbent (cost, audit) is cut; the search ends when its stack is empty, so the result is proved.

Long conversations. Rows are range-partitioned by (conversation, turn, ...), so one conversation may span many tasks. Each task
streams its rows and searches pieces of at most ``PIECE`` rows: a piece that is a whole conversation from the start state,
any other one between all states. The pieces of a conversation are then folded in order, with one dominance table
of four states. The digest of the repaired text streams the sorted rows through one running hash. No task holds the
rows of a conversation; it holds a piece, an Arrow batch and an audit of one character a row.

Defined results: a null id, turn, role or text counts as one space in the damage key, the role and the text; null turns come
first and are no part of the gaps; null ids form one conversation. Rows of one turn are taken by role, then by the digest of
their text, then copies; repeated rows are duplicates of each other. Texts of any length are read whole. A role
whose first character is not s, u or a (empty ones too) fits nowhere and is never kept. A conversation whose rows are all
dropped has zeros, an empty audit and the digest of an empty text. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import stage, table

PIECE = 256
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: the role that each state waits for, and the state after it
WANTS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ACCEPTING = (START, ASSISTANT)
REACHED = {START: {START, SYSTEM, USER, ASSISTANT}, SYSTEM: {SYSTEM, USER, ASSISTANT}, USER: {USER, ASSISTANT}, ASSISTANT: {USER, ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
NEVER = 1 << 60


# ------------------------------------------------------------------------------------------------ the search


def suffix_bounds(rows: list[tuple[str, str]], goal_side: int) -> list[tuple[int, int]]:
    """For each number of consumed rows: least costs to the goal while a user (0) or an assistant row (1) is awaited.

    The relaxed grammar lets a system row stand wherever a user row is awaited, so no true cost is below the bound.
    """
    here = [INSERT, INSERT]
    here[goal_side] = 0
    out = [tuple(here)]
    for initial, fault in reversed(rows):
        after, now = out[-1], []
        for side in (0, 1):
            least = after[side] + DELETE
            if fault not in "bd":
                extra = CUT if fault == "t" else 0
                least = min(least, after[1 - side] + REROLE + extra)
                if initial == "ua"[side]:
                    least = min(least, after[1 - side] + extra)
                elif initial == "s" and side == 0:
                    least = min(least, after[0] + extra)
            now.append(least)
        out.append((min(now[0], now[1] + INSERT), min(now[1], now[0] + INSERT)))
    return out[::-1]


def best_repairs(rows: list[tuple[str, str]], entry: int, goals: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Cheapest (cost, audit, goal state) that leads from ``entry`` over all rows to one of the goals, None if there is none.

    ``rows`` holds (role initial, fault): b blank, d duplicate, t truncated, - none.
    """
    n = len(rows)
    bounds = suffix_bounds(rows, int(goals[0] == USER))
    table: dict[tuple[int, int], tuple[int, str]] = {}
    incumbent = (NEVER, "", -1)
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if REACHED[state].isdisjoint(goals):
            continue
        known = table.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        least = cost + bounds[i][state == USER]
        if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][: len(audit)]):
            continue
        table[i, state] = (cost, audit)
        if i == n and state in goals and (cost, audit) < incumbent[:2]:
            incumbent = (cost, audit, state)
        steps = [(i, AFTER[state], cost + INSERT, audit + "I")]
        if i < n:
            initial, fault = rows[i]
            steps.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault not in "bd":
                paid = cost + (CUT if fault == "t" else 0)
                steps.append((i + 1, AFTER[state], paid + REROLE, audit + "R"))
                if initial == WANTS[state]:
                    steps.append((i + 1, AFTER[state], paid, audit + "K"))
                elif initial == "s" and state == START:
                    steps.append((i + 1, SYSTEM, paid, audit + "K"))
        # the most promising step is taken first: least bound, then ASCII order
        steps.sort(key=lambda s: (s[2] + bounds[s[0]][s[1] == USER], s[3]), reverse=True)
        stack.extend(steps)
    return incumbent if incumbent[0] < NEVER else None


def piece_table(rows: list[tuple[str, str]], whole: bool) -> list[dict]:
    """Cheapest repairs of a piece between states; a whole conversation only needs the way from the start to acceptance."""
    wanted = [(START, ACCEPTING)] if whole else [(a, (b,)) for a in range(4) for b in range(4)]
    found = [(entry, best_repairs(rows, entry, goals)) for entry, goals in wanted]
    return [{"entry": e, "exit": f[2], "cost": f[0], "audit": f[1]} for e, f in found if f]


def fold(states: dict[int, tuple[int, str]], ways: list[dict]) -> dict[int, tuple[int, str]]:
    """Extends the best (cost, audit) of each state by one more piece."""
    out: dict[int, tuple[int, str]] = {}
    for w in ways:
        if w["entry"] in states:
            cost, audit = states[w["entry"]]
            new = (cost + w["cost"], audit + w["audit"])
            if w["exit"] not in out or new < out[w["exit"]]:
                out[w["exit"]] = new
    return out


# ------------------------------------------------------------------------------------------------ rows and faults


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: every row after the damage that the checksum of ``conv_id:turn`` chooses."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        space("role").alias("role"),
        space("text").alias("text"),
        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("act"),
    ).where("act <> 0")
    act, text = F.col("act"), F.col("text")
    text = F.when(act == 1, "").when(act == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(act == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(act == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode_outer(copies).alias("copy")
    )


def with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged rows with texts, and without them the rows that the search reads: (conv_id, order columns, initial, fault)."""
    end = F.substring(F.col("core"), -1, 1)
    plain = F.when(F.col("core") == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise("-")
    staged = stage(
        rows.withColumn("core", _trimmed(F.col("text")))
        .withColumn("plain", plain)
        .withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
        .withColumn("uid", F.monotonically_increasing_id())
        .drop("core"),
        "damaged",
    )
    light = staged.drop("text")
    place = F.struct(F.col("turn"), F.col("copy"), F.col("uid"))  # nulls come first in a struct, too
    repeated = (
        light.groupBy("conv_id", "role", "digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("first").isNotNull() & (F.col("first") < place)
    initial = F.substring("role", 1, 1)
    faults = light.join(repeated, same, "left").select(
        *ORDER,
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when((F.col("plain") != "b") & later, "d").otherwise(F.col("plain")).alias("fault"),
    )
    return staged, stage(faults, "faults")


ORDER = ("conv_id", "turn", "role", "digest", "copy", "uid")


def _ordered() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ORDER]


# ------------------------------------------------------------------------------------------------ pieces

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
LEGAL = ("su", "ua", "au")


def _pieces(batches: Iterator[pa.RecordBatch], piece: int, id_type: pa.DataType, turn_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int64())]
        + [(c, pa.int64()) for c in COUNTS]
        + [("least", turn_type), ("most", turn_type), ("head", pa.string()), ("tail", pa.string())]
        + [("ways", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
    )
    part, out, seq = TaskContext.get().partitionId(), [], 0
    rows: list[tuple[str, str]] = []
    turns: list = []
    conv, opened, first = None, False, True  # ``first``: the conversation may have begun in an earlier task

    def closed(whole: bool) -> dict:
        stats = {"blank": "b", "duplicate": "d", "truncated": "t"}
        given = [t for t in turns if t is not None]
        return {
            "conv_id": conv, "part": part, "seq": seq, "least": given[0] if given else None, "most": given[-1] if given else None,
            "head": rows[0][0], "tail": rows[-1][0], "turns": len(set(given)),
            "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False)),
            "ways": piece_table(rows, whole), **{k: sum(f == v for _, f in rows) for k, v in stats.items()},
        }

    begun = False  # an earlier piece of this conversation was closed in this task
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")]
        for c, turn, initial, fault in zip(*columns, strict=True):
            if opened and c != conv:
                out.append(closed(not first and not begun))
                rows, turns, first, begun, seq = [], [], False, False, seq + 1
            elif len(rows) == piece:
                out.append(closed(False))
                rows, turns, begun, seq = [], [], True, seq + 1
            conv, opened = c, True
            rows.append((initial, fault))
            turns.append(turn)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if opened:
        out.append(closed(False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _folded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces, which come in order."""
    out, now = [], None

    def ended(now: dict) -> dict:
        cost, audit = min(now["states"][s] for s in ACCEPTING if s in now["states"])
        gaps = 0 if now["least"] is None else now["most"] - now["least"] + 1 - now["turns"]
        return {"conv_id": now["conv_id"], "gaps": gaps, "cost": cost, "audit": audit, **{c: now[c] for c in COUNTS[:4]}}

    for batch in batches:
        for p in batch.to_pylist():
            if now is None or now["conv_id"] != p["conv_id"]:
                if now is not None:
                    out.append(ended(now))
                now = p | {"states": fold({START: (0, "")}, p["ways"])}
            else:
                shared = int(now["most"] is not None and now["most"] == p["least"])  # a turn cut by the border of two pieces
                broken = int(now["tail"] + p["head"] not in LEGAL)
                now |= {c: now[c] + p[c] for c in COUNTS}
                now |= {"turns": now["turns"] - shared, "illegal": now["illegal"] + broken, "tail": p["tail"], "states": fold(now["states"], p["ways"])}
                now |= {"least": p["least"] if now["least"] is None else now["least"], "most": now["most"] if p["most"] is None else p["most"]}
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if now is not None:
        out.append(ended(now))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def solved(faults: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows."""
    kind = {f.name: f.dataType for f in faults.schema.fields}
    id_arrow, turn_arrow = _arrow(kind["conv_id"]), _arrow(kind["turn"])
    id_sql, turn_sql = kind["conv_id"].simpleString(), kind["turn"].simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    ways = "ways array<struct<entry:int, exit:int, cost:bigint, audit:string>>"
    pieces = (
        faults.repartitionByRange(*_ordered())
        .sortWithinPartitions(*_ordered())
        .mapInArrow(
            lambda b: _pieces(b, piece, id_arrow, turn_arrow),
            f"conv_id {id_sql}, part int, seq bigint, {counts}, least {turn_sql}, most {turn_sql}, head string, tail string, {ways}",
        )
    )  # the numbers of range partitions follow the order of the rows
    schema = pa.schema([("conv_id", id_arrow), *((c, pa.int64()) for c in ("gaps", *COUNTS[:4], "cost")), ("audit", pa.string())])
    return (
        stage(pieces, "pieces")
        .repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
        .mapInArrow(
            lambda b: _folded(b, schema),
            f"conv_id {id_sql}, gaps bigint, " + ", ".join(f"{c} bigint" for c in COUNTS[:4]) + ", cost bigint, audit string",
        )
    )


# ------------------------------------------------------------------------------------------------ repaired texts


def repaired_rows(staged: DataFrame, heads: DataFrame) -> DataFrame:
    """The kept, changed and inserted rows of every conversation, in order: conv_id, place, role, text."""
    return _along_audit(staged, heads, _emit_rows, lambda k: f"conv_id {k}, place bigint, role string, text string")


def with_digest(staged: DataFrame, heads: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of the repaired ``role:text`` rows, joined by newlines."""
    return _along_audit(staged, heads, _emit_digests, lambda k: f"conv_id {k}, repaired_sha256 string")


def _along_audit(staged: DataFrame, heads: DataFrame, emit, sql) -> DataFrame:
    """Streams every conversation behind its audit: the audit comes first, then the rows in order."""
    kind = staged.schema["conv_id"].dataType
    arrow = _arrow(kind)
    own = {c: F.lit(None).cast(staged.schema[c].dataType).alias(c) for c in ORDER[1:]}
    first = heads.select("conv_id", F.lit(0).alias("kind"), *own.values(), F.col("audit").alias("text"))
    rows = staged.select("conv_id", F.lit(1).alias("kind"), *ORDER[1:], "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", *ORDER[1:])]
    return (
        first.unionByName(rows)
        .repartition("conv_id")
        .sortWithinPartitions(*order)
        .select("conv_id", "kind", "role", "text")
        .mapInArrow(lambda b: emit(_repairs(b), arrow), sql(kind.simpleString()))
    )


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None, None) at the start of a conversation, then (conv_id, role, text) for each repaired row."""
    audit, at, state, conv = "", 0, START, None

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv, NAMES[WANTS[state]], ""
            state, at = AFTER[state], at + 1

    for batch in batches:
        for c, kind, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "kind", "role", "text")), strict=True):
            if kind == 0:
                audit, at, state, conv = text, 0, START, c
                yield c, None, None
            else:
                step, at = audit[at], at + 1
                if step == "K":
                    yield c, role, text
                    state = SYSTEM if role[0] == "s" else AFTER[state]
                elif step == "R":
                    yield c, NAMES[WANTS[state]], text
                    state = AFTER[state]
            yield from inserted()


def _emit_digests(rows: Iterator[tuple], arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", arrow), ("repaired_sha256", pa.string())])
    out: list[dict] = []
    conv, running, n = None, None, 0
    for c, role, text in rows:
        if role is None:
            if running is not None:
                out.append({"conv_id": conv, "repaired_sha256": running.hexdigest()})
            conv, running, n = c, hashlib.sha256(), 0
        else:
            running.update(f"{chr(10) if n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            n += 1
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if running is not None:
        out.append({"conv_id": conv, "repaired_sha256": running.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _emit_rows(rows: Iterator[tuple], arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", arrow), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out: list[dict] = []
    place = held = 0
    for c, role, text in rows:
        place = 0 if role is None else place + 1
        if role is not None:
            out.append({"conv_id": c, "place": place, "role": role, "text": text})
            held += len(text)
        if len(out) >= 1000 or held > 1 << 22:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repairs(conversations: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Staged rows after the damage, and one staged row per original conversation with its counts, cost and audit."""
    staged, faults = with_faults(damaged(conversations))
    found = solved(faults, piece)
    named = found.withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct().join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("gaps", *COUNTS[:4], "cost")} | {"audit": F.coalesce("audit", F.lit(""))}
    return staged, stage(every.withColumns(zero), "audits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged, heads = repairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    digests = with_digest(staged, heads).withColumnRenamed("conv_id", "c")
    joined = heads.join(digests, F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.select("conv_id", "gaps", *COUNTS[:4], "cost", "audit", "repaired_sha256")


_CRC = (
    "list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(octet_length(encode(k))), "
    "lambda i: ('0x' || hex(encode(k))[2 * i + 1:2 * i + 2])::UBIGINT)), lambda c, b: "
    "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1))))"
)
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), acts AS (SELECT *, xor({_CRC}, 4294967295::UBIGINT) % 20 AS act FROM keyed
), rows_after AS (
  SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role,
         CASE act WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM acts, (VALUES (0), (1)) AS c(copy) WHERE act <> 0 AND (copy = 0 OR act = 3)
), placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         left(role, 1) AS initial, lead(left(role, 1)) OVER w AS next_initial, right(rtrim(text, {_WHITE}), 1) AS last
  FROM rows_after WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), faulted AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM placed
), stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (next_initial IS NOT NULL AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulted GROUP BY conv_id
), steps(a, b, op, cost) AS (  -- states: 0 start, 1 after system, 2 after user, 3 after assistant
  VALUES (0, 2, 'R', 2), (1, 2, 'R', 2), (2, 3, 'R', 2), (3, 2, 'R', 2), (0, 0, 'D', 3), (1, 1, 'D', 3), (2, 2, 'D', 3), (3, 3, 'D', 3),
         (0, 1, 'Ks', 0), (0, 2, 'Ku', 0), (1, 2, 'Ku', 0), (3, 2, 'Ku', 0), (2, 3, 'Ka', 0)
), inserts(a, b, op, cost) AS (  -- no, one or two rows inserted
  VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 3, 'I', 2), (3, 2, 'I', 2),
         (0, 3, 'II', 4), (1, 3, 'II', 4), (2, 2, 'II', 4), (3, 3, 'II', 4)
), search AS (
  SELECT conv_id, 0::BIGINT AS i, b AS state, cost, op AS audit FROM stats, inserts WHERE a = 0
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT s.conv_id, f.i, n.b AS state, s.cost + m.cost + n.cost + CASE WHEN f.fault = 't' AND m.op <> 'D' THEN 1 ELSE 0 END AS cost,
           s.audit || left(m.op, 1) || n.op AS audit,
           row_number() OVER (PARTITION BY s.conv_id, f.i, n.b
             ORDER BY s.cost + m.cost + n.cost + CASE WHEN f.fault = 't' AND m.op <> 'D' THEN 1 ELSE 0 END, s.audit || left(m.op, 1) || n.op) AS best
    FROM search s JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
    JOIN steps m ON m.a = s.state AND (m.op IN ('R', 'D') OR m.op = 'K' || f.initial) AND (m.op = 'D' OR f.fault NOT IN ('b', 'd'))
    JOIN inserts n ON n.a = m.b
  ) WHERE best = 1
), solved AS (
  SELECT s.conv_id, min(struct_pack(cost := s.cost, audit := s.audit)) AS found
  FROM search s JOIN stats t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.i = t.n WHERE state IN (0, 3) GROUP BY s.conv_id
), edits AS (  -- one row per edit; a repaired row's place tells its role
  SELECT conv_id, p, found.audit[p] AS op, len(replace(found.audit[1:p], 'I', '')) AS i,
         len(replace(found.audit[1:p], 'D', '')) AS place
  FROM (SELECT conv_id, found, unnest(range(1, len(found.audit) + 1)) AS p FROM solved)
), kept AS (
  SELECT e.conv_id, e.p, e.op, e.place, f.role, coalesce(CASE WHEN op <> 'I' THEN f.text END, '') AS text,
         max(CASE WHEN e.op = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.op <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                             chr(10) ORDER BY p) AS joined FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(found.cost, 0)::BIGINT AS cost,
       coalesce(found.audit, '') AS audit, sha256(coalesce(joined, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved v ON v.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
