"""Reading tool decisions: JSON replies, aliases, validation, coercions and argument comparison."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import rules as R
from inkwell.functions import text as T

DECISION_SCHEMA = "thought string, action string, arguments map<string,variant>"
NO_ARGUMENTS = "map<string,struct<kind:string,value:string>>"


def normalize_action(action: Column, aliases: dict[str, str]) -> Column:
    """Alias of the trimmed lower-case name, else the trimmed name."""
    name = T.strip(action)
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(name)), name)


def json_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, code fences removed; NULL when absent."""
    bare = T.strip(text)
    fenced = F.regexp_replace(
        F.regexp_replace(bare, f"^(?i)```(?:json)?{T.WS_CLASS}*", ""), f"{T.WS_CLASS}*```$", ""
    )
    body = F.when(F.startswith(bare, F.lit("```")), fenced).otherwise(bare)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))


def first_object(text: str | None) -> str | None:
    """First substring that decodes as a JSON object; used only where the whole slice is not one."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            value = None
        if isinstance(value, dict):
            return text[at:end]
        at = text.find("{", at + 1)
    return None


def scan_object(text: Column) -> Column:
    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return scan(text)


def typed_arguments(arguments: Column) -> Column:
    """Arguments with the JSON kind of every value: INT, FLOAT or TEXT."""

    def one(key, value):
        kind = F.schema_of_variant(value)
        return F.struct(
            F.when(kind == "BIGINT", F.lit("INT"))
            .when(F.startswith(kind, F.lit("DECIMAL")) | (kind == "DOUBLE"), F.lit("FLOAT"))
            .otherwise(F.lit("TEXT"))
            .alias("kind"),
            value.cast("string").alias("value"),
        )

    return F.coalesce(F.transform_values(arguments, one), F.create_map().cast(NO_ARGUMENTS))


def parse_predictions(predictions: DataFrame) -> DataFrame:
    """Adds ``predicted_action, predicted_arguments, valid_json`` and drops ``prediction``.

    Replies that are one JSON object, possibly fenced, are read by the JVM. Only
    the rest is scanned for its first decodable object in a Python worker.
    """
    keep = [c for c in predictions.columns if c != "prediction"]
    sliced = predictions.withColumn("_slice", json_slice(F.col("prediction")))
    whole = sliced.withColumn("_ok", F.try_parse_json("_slice").isNotNull())
    needs_scan = F.col("_slice").isNotNull() & ~F.col("_ok")
    found = whole.withColumn("_scanned", scan_object(F.when(needs_scan, F.col("_slice")))).withColumn(
        "_json", F.when(F.col("_ok"), F.col("_slice")).otherwise(F.col("_scanned"))
    )
    parsed = found.withColumn("_d", F.from_json("_json", DECISION_SCHEMA)).withColumn(
        "_action", normalize_action(F.coalesce(F.col("_d.action"), F.lit("")), R.DECISION_ALIASES)
    )
    valid = F.col("_json").isNotNull() & F.col("_action").isin(list(R.VALID_ACTIONS))
    return parsed.select(
        *keep,
        F.when(valid, F.col("_action")).otherwise(F.lit(R.INVALID_ACTION)).alias("predicted_action"),
        F.when(valid, typed_arguments(F.col("_d.arguments"))).otherwise(F.create_map().cast(NO_ARGUMENTS)).alias("predicted_arguments"),
        valid.alias("valid_json"),
    )


def value_match(expected: Column, actual: Column) -> Column:
    """Numbers compare as numbers of the expected kind, everything else as white-space-normalised text."""
    number = actual["value"].try_cast("double")
    as_float = F.abs(number - expected["value"].try_cast("double")) < 1e-6
    whole = F.when(actual["kind"] == "FLOAT", number.try_cast("bigint")).otherwise(actual["value"].try_cast("bigint"))
    as_int = whole == expected["value"].try_cast("bigint")
    as_text = T.collapse_spaces(expected["value"]) == T.collapse_spaces(actual["value"])
    return F.coalesce(
        F.when(expected["kind"] == "FLOAT", as_float).when(expected["kind"] == "INT", as_int).otherwise(as_text), F.lit(False)
    )


def arguments_match(expected_action: Column, expected: Column, actual: Column) -> Column:
    """All expected arguments are there and agree; a final answer only has to be non-empty."""
    answer = F.try_element_at(actual, F.lit("answer"))["value"]
    each = F.forall(
        F.map_entries(expected),
        lambda e: F.coalesce(value_match(e["value"], F.try_element_at(actual, e["key"])), F.lit(False)),
    )
    return F.when(expected_action == R.FINAL_ACTION, T.strip(F.coalesce(answer, F.lit(""))) != "").otherwise(each)


def truthy(value: Column) -> Column:
    """Text flags: everything but a few refusal words is true."""
    return ~F.lower(T.strip(F.coalesce(value, F.lit("true")))).isin(list(R.FALSE_WORDS))


def clamp_confidence(value: Column, default: float = 0.6) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def planned_route(decisions: DataFrame) -> DataFrame:
    """Validate planner decisions ``use_tool, tool_name, confidence, reason`` against the tool catalog.

    Adds ``route`` (NULL for the local path) and ``error`` for unknown tools.
    """
    catalog = F.create_map(
        *[
            x
            for tool, skill, intent, text in R.PLANNER_CATALOG
            for x in (
                F.lit(tool),
                F.struct(F.lit(intent).alias("intent"), F.lit(skill).alias("skill"), F.lit(text).alias("description")),
            )
        ]
    )
    raw = T.strip(F.coalesce(F.col("tool_name"), F.lit("")))
    tool = normalize_action(raw, R.PLANNER_ALIASES)
    local = ~truthy(F.col("use_tool")) | (tool == R.LOCAL_TOOL)
    spec = F.try_element_at(catalog, tool)
    reason = T.strip(F.coalesce(F.nullif(F.col("reason"), F.lit("")), spec["description"]))
    route = F.struct(
        spec["intent"].alias("intent"), spec["skill"].alias("skill"), tool.alias("tool_name"), reason.alias("reason"),
        clamp_confidence(F.col("confidence")).alias("confidence"), F.lit("llm_tool_planner").alias("planner_mode"),
    )
    return decisions.withColumn("route", F.when(~local & spec.isNotNull(), route)).withColumn(
        "error", F.when(~local & spec.isNull(), F.concat(F.lit("Unsupported planner tool: "), F.coalesce(F.nullif(raw, F.lit("")), tool)))
    )


def tool_risk(decisions: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``risk`` of recorded calls ``name, read_only_hint``: read_only, side_effect_allowed or side_effect (blocked)."""
    prefixed = F.lit(False)
    for prefix in R.READ_ONLY_PREFIXES:
        prefixed = prefixed | F.startswith(F.lower("name"), F.lit(prefix))
    read_only = F.coalesce(F.col("read_only_hint"), F.lit(False)) | prefixed
    flagged = decisions.withColumn("_ro", read_only)
    if allowed is not None:
        flagged = flagged.join(allowed.select("name").distinct().withColumn("_allowed", F.lit(True)), "name", "left")
    else:
        flagged = flagged.withColumn("_allowed", F.lit(False))
    return flagged.withColumn(
        "risk",
        F.when(F.col("_ro"), F.lit("read_only"))
        .when(F.coalesce("_allowed", F.lit(False)), F.lit("side_effect_allowed"))
        .otherwise(F.lit("side_effect")),
    ).withColumn("blocked", F.col("risk") == "side_effect").drop("_ro", "_allowed")


def decision_prompt(instruction: Column, catalog: Column, rules_text: Column, query: Column) -> Column:
    """Prompt text for one decision; the wording is the caller's."""
    schema = '{"thought":"简短思考","action":"工具名或 final_answer","arguments":{"参数名":"参数值"}}'
    return F.concat(
        instruction, F.lit("\n\n可用工具目录：\n"), catalog, F.lit(f"\n\n输出 JSON schema：\n{schema}\n\n决策规则：\n"),
        rules_text, F.lit("\n\n用户问题："), query, F.lit("\n\n只返回 JSON："),
    )


def decision_json(thought: Column, action: Column, arguments: Column) -> Column:
    """Compact decision object; ``arguments`` is a map or struct."""
    return F.to_json(F.struct(thought.alias("thought"), action.alias("action"), arguments.alias("arguments")))
