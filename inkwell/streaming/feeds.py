"""Structured Streaming jobs. The same rows in batch are the reference for each of them.

Results follow from the order of the rows, not from how they fall into triggers: inside a trigger the state functions
sort by the order column, and nothing is decided before the rows that decide it are there. Rows must not arrive in an
earlier trigger than rows that precede them. State is kept per session or upload; a session holds at most the
rows below its token threshold plus one turn.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.config import DEFAULTS, Settings
from inkwell.sources import store

RUN_EVENT_SCHEMA = "run_id string, seq bigint, event_type string, emitted_at timestamp, payload string"
CLOSING = ("complete", "error")


def read_run_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Typed stream over newline-delimited JSON event files."""
    return spark.readStream.schema(RUN_EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_event_log(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append-only event log as newline-delimited JSON."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def run_states(events: DataFrame) -> DataFrame:
    """Per run: number of events up to the closing one, and how it closed. Works on a batch of the log."""
    closing = F.when(F.col("event_type").isin(*CLOSING), F.col("seq"))
    ends = events.groupBy("run_id").agg(
        F.min(closing).alias("closed_at"),
        F.min_by("event_type", closing).alias("closed_by"),
    )
    counted = events.join(ends, "run_id").where(F.col("closed_at").isNull() | (F.col("seq") <= F.col("closed_at")))
    return counted.groupBy("run_id").agg(
        F.count("*").alias("n_events"),
        F.coalesce(F.first("closed_by"), F.lit("open")).alias("state"),
    )


def guard_sequences(turns: DataFrame) -> DataFrame:
    """Stream of ``session_id, sequence_id, arrived_at`` → every row with ``expected`` and ``accepted``.

    Rows are judged in order of arrival. A row is accepted only when it is the next number of its session; others do
    not move the session on, so 2 before 1 is rejected in one trigger as in two.
    """

    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["arrived_at", "sequence_id"], kind="stable")
        expected, accepted = [], []
        for value in rows["sequence_id"]:
            expected.append(last + 1)
            accepted.append(value == last + 1)
            last += int(accepted[-1])
        state.update((last,))
        yield pd.DataFrame(
            {"session_id": key[0], "sequence_id": rows["sequence_id"].to_numpy(), "expected": expected, "accepted": accepted}
        )

    return turns.select("session_id", F.col("sequence_id").cast("bigint"), "arrived_at").groupBy("session_id").applyInPandasWithState(
        step,
        "session_id string, sequence_id bigint, expected bigint, accepted boolean",
        "last bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def compact_sessions(items: DataFrame, settings: Settings = DEFAULTS, answer_ordinal: int = 1) -> DataFrame:
    """Stream of working rows ``session_id, sequence_id, ordinal, id, tokens`` → compaction batches.

    A turn is complete with its answer row (``ordinal`` at least ``answer_ordinal``) or with the first row of another
    turn. After a complete turn, a session above its threshold hands out its oldest rows up to the target and keeps the
    rest; an open turn waits in the state.
    """
    threshold = max(1, settings.working_token_threshold)
    target = max(1, math.ceil(threshold * settings.compaction_share))

    def step(key, batches, state: GroupState):
        if state.exists:
            ids, tokens, turn, open_rows = list(state.get[0]), list(state.get[1]), state.get[2], state.get[3]
        else:
            ids, tokens, turn, open_rows = [], [], -1, 0
        rows = pd.concat(list(batches)).sort_values(["sequence_id", "ordinal", "id"], kind="stable")
        out = []

        def complete():
            total = sum(tokens)
            if total > threshold:
                taken, used = 0, 0
                while used < target:
                    used += tokens[taken]
                    taken += 1
                out.append((key[0], turn, used, total, ids[:taken]))
                del ids[:taken], tokens[:taken]

        for number, ordinal, name, size in zip(rows["sequence_id"], rows["ordinal"], rows["id"], rows["tokens"]):
            if open_rows and number != turn:
                complete()
                open_rows = 0
            turn = int(number)
            ids.append(name)
            tokens.append(int(size))
            open_rows += 1
            if ordinal >= answer_ordinal:
                complete()
                open_rows = 0
        state.update((ids, tokens, turn, open_rows))
        yield pd.DataFrame(out, columns=["session_id", "trigger_sequence_id", "compacted_tokens", "total_tokens", "item_ids"])

    return items.select(
        "session_id", F.col("sequence_id").cast("bigint"), F.col("ordinal").cast("int"), "id", F.col("tokens").cast("int")
    ).groupBy("session_id").applyInPandasWithState(
        step,
        "session_id string, trigger_sequence_id bigint, compacted_tokens bigint, total_tokens bigint, item_ids array<string>",
        "ids array<string>, tokens array<int>, turn bigint, open_rows int",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def track_uploads(parts: DataFrame) -> DataFrame:
    """Stream of parts ``upload_id, part_index, total_chunks`` → one row per upload when its last part arrives.

    Parts outside their upload are rejected and repeated ones are dropped by key, so the count of an upload reaches its
    total exactly once and never changes again. State and counting stay in the JVM. Runs in update mode (see
    :func:`run_updates`).
    """
    inside = parts.where((F.col("part_index") >= 0) & (F.col("part_index") < F.col("total_chunks")))
    fresh = inside.select("upload_id", "part_index", F.col("total_chunks").cast("int")).dropDuplicates(["upload_id", "part_index"])
    counts = fresh.groupBy("upload_id").agg(F.count("*").alias("n"), F.max("total_chunks").alias("total_chunks"))
    return counts.where(F.col("n") == F.col("total_chunks")).select("upload_id", "total_chunks")


def _batch_name(checkpoint: str, number: int) -> str:
    """The same micro-batch of the same stream has the same name when it is replayed."""
    return f"feed-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}-{number:012d}"


def index_feed(changes: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULTS) -> DataStreamWriter:
    """Asset change stream → chunk index. Every micro-batch appends only its own changes; a replayed one replaces them."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: store.apply_asset_changes(batch, path, settings, _batch_name(checkpoint, number))
    )


def fact_feed(drafts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Fact draft stream → fact table, as in :func:`index_feed`."""
    return drafts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: store.apply_fact_drafts(batch, path, _batch_name(checkpoint, number))
    )


def run_available(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over everything that is there now, into a Parquet folder."""
    query = (
        frame.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Run an update-mode stream over everything that is there now.

    Every micro-batch owns one folder and overwrites it, so a replayed batch adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    query = (
        frame.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
