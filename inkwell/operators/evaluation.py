"""Retrieval and tool-decision evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import decisions as D
from inkwell.functions import rules as R

MISSING_RANK = 999


def gold_hits(evidence: DataFrame, gold: DataFrame, text: Column) -> DataFrame:
    """``case_id, marker, rank`` for gold markers contained in the top rows of their own case.

    The containment test runs on the few rows of a case, after an equi-join.
    """
    return evidence.join(gold, "case_id").where(F.contains(text, F.col("marker"))).select("case_id", "marker", "rank")


def retrieval_metrics(cases: DataFrame, evidence: DataFrame, gold: DataFrame, text: Column, drift: Column | None = None) -> DataFrame:
    """Per case: hit@1/3/5, MRR@5, coverage@5, first gold rank and drift.

    ``cases(case_id)``, ``evidence(case_id, rank, …)``, ``gold(case_id, marker)``.
    """
    hits = gold_hits(evidence, gold, text)
    first = hits.groupBy("case_id").agg(
        F.min("rank").alias("first"),
        F.count_distinct(F.when(F.col("rank") <= 5, F.col("marker"))).alias("n_found"),
    )
    wanted = gold.groupBy("case_id").agg(F.count_distinct("marker").alias("n_gold"))
    drifted = (F.lit(False) if drift is None else drift).alias("drift")
    top = evidence.where(F.col("rank") == 1).select("case_id", drifted)
    r = F.col("first")
    return (
        cases.join(first, "case_id", "left")
        .join(wanted, "case_id", "left")
        .join(top, "case_id", "left")
        .select(
            *cases.columns,
            *[F.when(r <= n, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"hit{n}") for n in (1, 3, 5)],
            F.when(r <= 5, 1.0 / r).otherwise(F.lit(0.0)).alias("mrr5"),
            F.coalesce(F.try_divide(F.col("n_found"), F.col("n_gold")), F.lit(0.0)).alias("coverage5"),
            F.coalesce(r, F.lit(MISSING_RANK)).alias("top_gold_rank"),
            F.when(F.coalesce("drift", F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0)).alias("drift"),
        )
    )


def summarize_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means per group, with the population deviation of the first gold rank."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_cases"),
        *[F.avg(c).alias(c) for c in ("hit1", "hit3", "hit5", "mrr5", "coverage5")],
        F.avg("top_gold_rank").alias("avg_rank"),
        F.stddev_pop("top_gold_rank").alias("rank_stdev"),
        F.avg("drift").alias("drift_rate"),
    )


# --- tool decisions --------------------------------------------------------------------


def unmatched(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """``id, stage, n_records, n_predictions`` wherever both counts are not one; a correct evaluation has no such row.

    Every stage that occurs must judge every record exactly once; without predictions, or without stages, stage is NULL.
    """
    staged = predictions if "stage" in predictions.columns else predictions.withColumn("stage", F.lit(None).cast("string"))
    stages = staged.agg(F.array_sort(F.collect_set("stage")).alias("stages")).scalar()
    wanted = records.groupBy("id").agg(F.count(F.lit(1)).alias("n_records")).withColumn("stage", F.explode_outer(stages))
    given = staged.groupBy("id", "stage").agg(F.count(F.lit(1)).alias("n_predictions"))
    w, g = wanted.alias("w"), given.alias("g")
    same = F.col("w.id").eqNullSafe(F.col("g.id")) & F.col("w.stage").eqNullSafe(F.col("g.stage"))
    zero = F.lit(0).cast("bigint")
    return w.join(g, same, "full_outer").select(
        F.coalesce("w.id", "g.id").alias("id"),
        F.coalesce("w.stage", "g.stage").alias("stage"),
        F.coalesce("n_records", zero).alias("n_records"),
        F.coalesce("n_predictions", zero).alias("n_predictions"),
    ).where("n_records <> 1 OR n_predictions <> 1")


def judge(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per case: expected and predicted action, validity, action match and argument match.

    ``records(id, category, expected)`` with ``expected`` as JSON
    ``{"action": …, "arguments": {…}}``; ``predictions(id, [stage,] prediction)``.
    """
    stage = ["stage"] if "stage" in predictions.columns else []
    parsed = D.parse_predictions(predictions.select("id", *stage, "prediction"))
    wanted = records.select("id", "category", F.from_json("expected", D.DECISION_SCHEMA).alias("_e")).select(
        "id",
        "category",
        D.normalize_action(F.coalesce("_e.action", F.lit("")), R.DECISION_ALIASES).alias("expected_action"),
        D.typed_arguments(F.col("_e.arguments")).alias("expected_arguments"),
    )
    joined = wanted.join(parsed, "id")
    same = F.col("expected_action") == F.col("predicted_action")
    return joined.select(
        "id",
        *stage,
        "category",
        "expected_action",
        "predicted_action",
        "valid_json",
        same.alias("action_match"),
        (same & D.arguments_match(F.col("expected_action"), F.col("expected_arguments"), F.col("predicted_arguments"))).alias(
            "arguments_match"
        ),
    )


def decision_metrics(judged: DataFrame, by: list[str] = ()) -> DataFrame:
    """Validity, accuracy, argument match, tool precision / recall / F1 and over-tool rate."""
    tool = list(R.TOOL_ACTIONS)
    wants, uses = F.col("expected_action").isin(tool), F.col("predicted_action").isin(tool)

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))

    counts = judged.groupBy(*by).agg(
        F.count("*").alias("total"),
        share(F.col("valid_json")).alias("valid_json_rate"),
        share(F.col("action_match")).alias("action_accuracy"),
        share(F.col("arguments_match")).alias("argument_match_rate"),
        F.count_if(wants).alias("n_wants"),
        F.count_if(~wants).alias("n_final"),
        F.count_if(uses).alias("n_uses"),
        F.count_if(wants & uses).alias("n_both"),
        F.count_if(~wants & uses).alias("n_over"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    p, r = F.col("tool_precision"), F.col("tool_recall")
    return (
        counts.withColumn("tool_precision", ratio("n_both", "n_uses"))
        .withColumn("tool_recall", ratio("n_both", "n_wants"))
        .withColumn("tool_needed_f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
        .withColumn("over_tool_rate", ratio("n_over", "n_final"))
        .drop("n_wants", "n_final", "n_uses", "n_both", "n_over")
    )


def confusion(judged: DataFrame, by: list[str] = ()) -> DataFrame:
    return judged.groupBy(*by, "expected_action", "predicted_action").agg(F.count("*").alias("n"))


REPORT_METRICS = ("valid_json_rate", "action_accuracy", "tool_needed_f1", "argument_match_rate", "over_tool_rate")


def report(metrics: DataFrame) -> DataFrame:
    """``stage, metric, value, percent`` for every reported rate."""
    long = metrics.unpivot("stage", list(REPORT_METRICS), "metric", "value")
    return long.withColumn("percent", F.format_string("%.1f%%", F.col("value") * 100))


# --- evidence labels -------------------------------------------------------------------


def label_counts(questions: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """The rows of ``questions(question, ...)`` with ``n_predicted, n_gold, n_both``; repeated labels count once, null ones never."""
    side = lambda rows, name: rows.where("question IS NOT NULL AND label IS NOT NULL").select("question", "label", F.lit(name).alias("side"))
    pairs = side(predicted, "p").unionByName(side(gold, "g")).groupBy("question", "label").agg(
        F.bool_or(F.col("side") == "p").alias("p"), F.bool_or(F.col("side") == "g").alias("g")
    )
    counts = pairs.groupBy("question").agg(
        F.count_if("p").alias("n_predicted"), F.count_if("g").alias("n_gold"), F.count_if(F.col("p") & F.col("g")).alias("n_both")
    )
    zero = F.lit(0).cast("bigint")
    filled = {c: F.coalesce(c, zero) for c in ("n_predicted", "n_gold", "n_both")}
    return questions.join(counts, "question", "left").withColumns(filled)


def evidence_scores(questions: DataFrame, predicted: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """Macro and micro precision, recall and F1 of evidence labels, by group and in all (``scope`` is group or all).

    Of an empty prediction the precision is 1 if there is nothing to find, else 0; the recall of an empty gold set is 1 if nothing was
    predicted, else 0. Both scopes come from one pass with grouping sets; the null group is a group of its own.
    """
    share = lambda n, of, other: F.when(of > 0, n / of).otherwise(F.when(other == 0, 1.0).otherwise(0.0))
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    n, p, g = F.col("n_both"), F.col("n_predicted"), F.col("n_gold")
    rows = label_counts(questions, predicted, gold).withColumns({"precision": share(n, p, g), "recall": share(n, g, p)})
    rows = rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    sums = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.when(F.grouping(by) == 1, "all").otherwise("group").alias("scope"), F.count(F.lit(1)).alias("n_questions"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[F.sum(c).alias(c) for c in ("n_both", "n_predicted", "n_gold")],
    )
    micro = sums.withColumns({"micro_precision": share(n, p, g), "micro_recall": share(n, g, p)})
    return micro.withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall"))).drop("n_both", "n_predicted", "n_gold")
