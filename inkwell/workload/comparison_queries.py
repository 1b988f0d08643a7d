"""Comparisons of systems over the driver tables: paired bootstrap, costs and frontiers, evidence labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import evaluation as E
from inkwell.operators import frontier as FR
from inkwell.operators import inference as I
from inkwell.session import spread, table
from inkwell.workload.registry import register

# ------------------------------------------------------------------------------------------------ paired bootstrap (K7)

_CASES = """cases AS (
      SELECT d.doc_id AS case_id, coalesce(lang, 'none') || ':quality' AS comparison,
             ((length(text) >= 300) = (quality = 1))::INT AS a, (contains(text, ', ') = (quality = 1))::INT AS b FROM documents d JOIN labels USING (doc_id)
      UNION ALL SELECT d.doc_id, coalesce(lang, 'none') || ':toxic',
             (contains(text, 'worthless') = (toxic = 1))::INT, (contains(text, '!!') = (toxic = 1))::INT FROM documents d JOIN labels USING (doc_id))"""


def judged_cases(spark, sf):
    """Two simple judges of quality and two of toxicity, right or wrong on every labelled document."""
    docs = spread(table(spark, sf, "documents"), "doc_id").join(table(spark, sf, "labels"), "doc_id")
    text, lang = F.col("text"), F.coalesce("lang", F.lit("none"))

    def task(name, a, b, truth):
        right = lambda flag: (flag == (F.col(truth) == 1)).cast("int")
        return docs.select(F.col("doc_id").alias("case_id"), F.concat(lang, F.lit(f":{name}")).alias("comparison"), right(a).alias("a"), right(b).alias("b"))

    quality = task("quality", F.length(text) >= 300, F.contains(text, F.lit(", ")), "quality")
    return quality.unionByName(task("toxic", F.contains(text, F.lit("worthless")), F.contains(text, F.lit("!!")), "toxic"))


@register(
    "paired_bootstrap",
    f"""WITH {_CASES},
    pairs AS (SELECT comparison, case_id, (b - a)::DOUBLE AS difference FROM cases WHERE a IS NOT NULL AND b IS NOT NULL),
    drawn AS (SELECT comparison, replicate, difference, {I.weight_sql('case_id', 'replicate')} AS w FROM pairs, range(1, {I.REPLICATES} + 1) AS r(replicate)),
    means AS (SELECT comparison, replicate, sum(w * difference) / nullif(sum(w), 0) AS mean FROM drawn GROUP BY ALL),
    spread AS (SELECT comparison, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high,
        least(1.0, 2 * (least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) + 1) / (count(*) + 1)) AS p_value FROM means WHERE mean IS NOT NULL GROUP BY comparison),
    tests AS (SELECT comparison, count(*) AS n, avg(difference) AS mean_difference, any_value(low) AS low, any_value(high) AS high, any_value(p_value) AS p_value
      FROM pairs LEFT JOIN spread USING (comparison) GROUP BY comparison),
    ranked AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p_value) AS rank FROM tests)
    SELECT comparison, n, round(mean_difference, 9) AS mean_difference, round(low, 9) AS low, round(high, 9) AS high, round(p_value, 9) AS p_value,
      round(least(1.0, min(p_value * m / rank) OVER (ORDER BY p_value DESC)), 9) AS q_value FROM ranked""",
)
def paired_bootstrap(spark, sf):
    found = I.paired_bootstrap(judged_cases(spark, sf))
    return found.select("comparison", "n", *[F.round(c, 9).alias(c) for c in ("mean_difference", "low", "high", "p_value", "q_value")])


# ------------------------------------------------------------------------------------------------ costs and frontier (K6)

_TASKS = """tasks AS (SELECT user_id, user_id % 10 AS config, count(*) AS n_runs, sum(value::DECIMAL(18, 2))::DOUBLE AS cost,
      count(*) FILTER (event_type = 'purchase') / count(*) AS quality,
      CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN sum(value::DECIMAL(18, 2))::DOUBLE / count(*) FILTER (event_type = 'purchase') END AS cost_per_good
      FROM events GROUP BY user_id)"""
_FRONT = """front AS (SELECT * FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM tasks o WHERE o.config = t.config AND o.cost <= t.cost AND o.quality >= t.quality
      AND (o.cost < t.cost OR o.quality > t.quality OR o.user_id < t.user_id)))"""


def task_costs(spark, sf):
    events = table(spark, sf, "events").withColumn("config", F.col("user_id") % 10)
    exact = F.col("value").cast("decimal(18,2)")
    costs = FR.cost_rollup(events.withColumn("value", exact), ["user_id", "config"], F.col("value"), F.col("event_type") == "purchase")
    return costs.withColumn("cost", F.col("cost").cast("double")).withColumn("cost_per_good", F.try_divide("cost", F.col("quality") * F.col("n_runs")))


@register("cost_rollup", f"WITH {_TASKS} SELECT user_id, n_runs, cost, round(quality, 9) AS quality, round(cost_per_good, 6) AS cost_per_good FROM tasks")
def cost_rollup(spark, sf):
    return task_costs(spark, sf).select("user_id", "n_runs", "cost", F.round("quality", 9).alias("quality"), F.round("cost_per_good", 6).alias("cost_per_good"))


@register("quality_cost_frontier", f"WITH {_TASKS}, {_FRONT} SELECT config, user_id, cost, round(quality, 9) AS quality FROM front")
def quality_cost_frontier(spark, sf):
    return FR.frontier(task_costs(spark, sf), "config", "user_id").select("config", "user_id", "cost", F.round("quality", 9).alias("quality"))


@register(
    "quality_cost_area",
    f"""WITH {_TASKS}, {_FRONT},
    slices AS (SELECT *, (cost - lag(cost) OVER w) * (quality + lag(quality) OVER w) / 2 AS slice FROM front WINDOW w AS (PARTITION BY config ORDER BY cost))
    SELECT config, count(*) AS n_frontier, min(cost) AS least_cost, max(cost) AS most_cost,
      round(CASE WHEN max(cost) > min(cost) THEN sum(slice) / (max(cost) - min(cost)) ELSE max(quality) END, 9) AS area FROM slices GROUP BY config""",
)
def quality_cost_area(spark, sf):
    return FR.quality_cost_area(task_costs(spark, sf), "config", "user_id").withColumn("area", F.round("area", 9))


# ------------------------------------------------------------------------------------------------ evidence labels (K5)

_SHARE = "CASE WHEN {of} > 0 THEN {n} / {of} WHEN {other} = 0 THEN 1.0::DOUBLE ELSE 0.0 END"
_F1 = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


@register(
    "evidence_label_scores",
    f"""WITH q AS (SELECT c_custkey AS question, c_mktsegment AS segment FROM customer WHERE c_custkey < 400),
    labels AS (SELECT user_id AS question, regexp_extract(props, '([0-9]+)', 1) AS label,
      bool_or(event_type IN ('click', 'view')) AS p, bool_or(event_type IN ('purchase', 'view')) AS g FROM events GROUP BY ALL),
    c AS (SELECT question, count(*) FILTER (p) AS n_predicted, count(*) FILTER (g) AS n_gold, count(*) FILTER (p AND g) AS n_both FROM labels GROUP BY question),
    filled AS (SELECT question, segment, coalesce(n_predicted, 0) AS np, coalesce(n_gold, 0) AS ng, coalesce(n_both, 0) AS nb FROM q LEFT JOIN c USING (question)),
    rates AS (SELECT *, {_SHARE.format(n='nb', of='np', other='ng')} AS p, {_SHARE.format(n='nb', of='ng', other='np')} AS r FROM filled),
    scored AS (SELECT *, {_F1.format(p='p', r='r')} AS f FROM rates),
    sums AS (SELECT segment, CASE WHEN grouping(segment) = 1 THEN 'all' ELSE 'group' END AS scope, count(*) AS n_questions, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf,
      sum(nb) AS nb, sum(np) AS np, sum(ng) AS ng FROM scored GROUP BY GROUPING SETS ((segment), ())),
    micro AS (SELECT *, {_SHARE.format(n='nb', of='np', other='ng')} AS p, {_SHARE.format(n='nb', of='ng', other='np')} AS r FROM sums)
    SELECT segment, scope, n_questions, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1,
      round(p, 9) AS micro_precision, round(r, 9) AS micro_recall, round({_F1.format(p='p', r='r')}, 9) AS micro_f1 FROM micro""",
)
def evidence_label_scores(spark, sf):
    """Customers as questions; labels of their events are cited (click, view) or right (purchase, view). Most customers have none."""
    questions = table(spark, sf, "customer").where("c_custkey < 400").select(F.col("c_custkey").alias("question"), F.col("c_mktsegment").alias("segment"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("question"), F.regexp_extract("props", "([0-9]+)", 1).alias("label"), "event_type")
    found = E.evidence_scores(questions, events.where("event_type IN ('click', 'view')"), events.where("event_type IN ('purchase', 'view')"), "segment")
    return found.select("segment", "scope", "n_questions", *[F.round(f"{a}_{b}", 9).alias(f"{a}_{b}") for a in ("macro", "micro") for b in ("precision", "recall", "f1")])
