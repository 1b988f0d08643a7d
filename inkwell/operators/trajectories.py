"""Transitions, shaped rewards and discounted returns of trajectories of any length.

A return obeys G(t) = r(t) + g * G(t + 1), so a stretch of steps maps the return behind it by an affine function, and
such functions compose. Steps are range-partitioned by (trajectory, order columns): one trajectory may span many tasks. A
task walks pieces of at most ``PIECE`` steps backwards and gives every step its return within the piece and the discount up to the
end of the piece. The pieces, a few thousandths of the rows, are then composed in reverse, and one join adds what lies behind
a piece. No trajectory is sorted or held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.session import materialized

PIECE = 4096


def _walked(batches: Iterator[pa.RecordBatch], schema: pa.Schema, given: list[str], gamma: float, size: int) -> Iterator[pa.RecordBatch]:
    part, piece, rows = TaskContext.get().partitionId(), 0, []

    def closed() -> pa.RecordBatch:
        ahead, discount, after = 0.0, 1.0, {"state": None, "potential": None}
        for n, r in enumerate(reversed(rows)):
            ahead, discount = r["reward"] + gamma * ahead, gamma * discount
            r |= {"ahead": ahead, "discount": discount, "next_state": after["state"], "next_potential": after["potential"]}
            r |= {"last": n == 0, "first": n == len(rows) - 1, "part": part, "piece": piece}
            after = r
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        for r in batch.select(given).to_pylist():
            if rows and (r["trajectory"] != rows[-1]["trajectory"] or len(rows) >= size):
                yield closed()
                rows, piece = [], piece + 1
            rows.append(r)
    if rows:
        yield closed()


def _composed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces come from the far end of each trajectory; every one gets what lies behind it. One number is carried along."""
    trajectory, behind, nearest = None, 0.0, None
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if nearest is None or p["trajectory"] != trajectory:
                trajectory, behind, nearest = p["trajectory"], 0.0, {"state": None, "potential": 0.0, "final": True}
            out.append(
                {"part": p["part"], "piece": p["piece"], "behind": behind, "behind_state": nearest["state"],
                 "behind_potential": nearest["potential"], "final": "final" in nearest}
            )
            behind, nearest = p["ahead"] + p["discount"] * behind, {"state": p["state"], "potential": p["potential"]}
        yield pa.RecordBatch.from_pylist(out, schema)


def transitions(steps: DataFrame, order: list[str], gamma: float, size: int = PIECE) -> DataFrame:
    """``trajectory, *order, state, action, reward, next_state, done, shaped_reward, discounted_return``.

    ``steps`` has trajectory, the order columns (together unique within a trajectory), state, action, reward and potential, the
    value of the potential function at the state. Shaped reward: reward + gamma * potential of the next state - own potential;
    the potential behind the last step is 0. Null rewards and potentials count as 0; null trajectories form one.
    """
    given = ["trajectory", *order, "state", "action", "reward", "potential"]
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    steps = steps.select(*given[:-2], zero("reward"), zero("potential"))
    fields = [(f.name, to_arrow_type(f.dataType)) for f in steps.schema.fields]
    state_type, state_arrow = steps.schema["state"].dataType.simpleString(), dict(fields)["state"]
    extra = [("ahead", pa.float64()), ("discount", pa.float64()), ("next_state", state_arrow), ("next_potential", pa.float64())]
    arrow = pa.schema(fields + extra + [("last", pa.bool_()), ("first", pa.bool_()), ("part", pa.int32()), ("piece", pa.int64())])
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema.fields)
    sql += f", ahead double, discount double, next_state {state_type}, next_potential double, last boolean, first boolean, part int, piece bigint"
    place = [F.col(c).asc_nulls_first() for c in ("trajectory", *order)]
    walked = materialized(  # the numbers of range partitions follow the order of the steps
        steps.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(lambda b: _walked(b, arrow, given, gamma, size), sql), "trajectory-steps"
    )
    tail = pa.schema(
        [("part", pa.int32()), ("piece", pa.int64()), ("behind", pa.float64()), ("behind_state", state_arrow), ("behind_potential", pa.float64()), ("final", pa.bool_())]
    )
    behind = (
        walked.where("first")
        .select("trajectory", "part", "piece", "ahead", "discount", "state", "potential")
        .repartition("trajectory")
        .sortWithinPartitions("trajectory", F.col("part").desc(), F.col("piece").desc())
        .mapInArrow(
            lambda b: _composed(b, tail), f"part int, piece bigint, behind double, behind_state {state_type}, behind_potential double, final boolean"
        )
    )
    potential = F.when(F.col("last"), F.col("behind_potential")).otherwise(F.col("next_potential"))
    return walked.join(behind, ["part", "piece"]).select(
        "trajectory", *order, "state", "action", "reward",
        F.when(F.col("last"), F.col("behind_state")).otherwise(F.col("next_state")).alias("next_state"),
        (F.col("last") & F.col("final")).alias("done"),
        (F.col("reward") + F.lit(gamma) * potential - F.col("potential")).alias("shaped_reward"),
        (F.col("ahead") + F.col("discount") * F.col("behind")).alias("discounted_return"),
    )
