"""User-level jobs composed from the operators; each takes tables and returns tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import rewrite, routing
from inkwell.operators import alignment, chunking, evaluation, evidence, memory, quality, retrieval
from inkwell.sources import ingest, store


def prepare_documents(spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Files of a folder → (assets, quarantine)."""
    return ingest.parse_files(ingest.read_folder(spark, folder, settings), settings)


chunk_documents = chunking.chunk_documents
apply_changes = store.apply_asset_changes
build_search_index = retrieval.write_index
read_search_index = retrieval.read_index
hybrid_search = retrieval.hybrid_search
rewrite_queries = rewrite.rewrite_queries
retrieve_with_replan = evidence.retrieve_with_replan
memory_context = memory.memory_context
score_answers = quality.score_answers
route_turns = routing.route_turns


def build_index(assets: DataFrame, path: str, settings: Settings = DEFAULTS) -> None:
    """Chunk all assets into a new index table."""
    changes = assets.select(
        F.lit("upsert").alias("op"), F.col("asset_id").cast("string").alias("asset_id"), "title", "asset_type", "content", F.lit(1).alias("version")
    )
    store.apply_asset_changes(changes, path, settings)


def retrieve_evidence(
    queries: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS, index: retrieval.SearchIndex | None = None
) -> DataFrame:
    """Questions → labelled evidence with parent context."""
    return evidence.retrieve(rewrite.rewrite_queries(queries, settings), chunks, settings, index)


def compact_memory(working: DataFrame, summaries: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Compaction with summary text supplied as ``summaries(project_id, session_id, summary_json)``.

    Sessions without a summary, or whose summary stores nothing, keep all their rows.
    """
    picked = memory.compaction_pick(working, settings)
    batches = memory.compaction_batches(picked, settings).join(summaries, memory.SESSION)
    episodes, drafts = memory.summary_episodes(batches), memory.summary_facts(batches)
    return {"episodic": episodes, "drafts": drafts, "working": memory.drop_compacted(working, picked, episodes, drafts)}


def evaluate_retrieval(
    cases: DataFrame, gold: DataFrame, strategies: dict[str, DataFrame], chunks: DataFrame, drift_marker: str = "DIST:", settings: Settings = DEFAULTS
) -> DataFrame:
    """Metrics per (strategy, case). A strategy is a table of weighted searches ``query_id, query_no, query, weight``.

    The strategy is part of the search key, so all strategies share one search.
    """
    columns = ["query_id", "query_no", "query", "weight"]
    tables = [rows.select(F.struct(F.lit(name).alias("strategy"), "query_id").alias("query_id"), *columns[1:]) for name, rows in strategies.items()]
    found = evidence.retrieve(reduce(DataFrame.unionByName, tables), chunks, settings).withColumnRenamed("query_id", "case_id")
    names = F.explode(F.array(*[F.lit(name) for name in strategies])).alias("strategy")

    def keyed(rows: DataFrame) -> DataFrame:
        key = F.struct("strategy", F.col("case_id").alias("query_id"))
        return rows.select("*", names).withColumn("case_id", key).drop("strategy")

    text = F.concat_ws("\n", "title", "snippet")
    rows = evaluation.retrieval_metrics(keyed(cases), found, keyed(gold), text, F.contains(text, F.lit(drift_marker)))
    return rows.withColumn("strategy", F.col("case_id.strategy")).withColumn("case_id", F.col("case_id.query_id"))


def evaluate_decisions(records: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """Cases, metrics, confusion and report by stage; a record without a prediction is an error."""
    gaps = evaluation.unmatched(records, predictions)
    if not gaps.isEmpty():
        raise ValueError("records and predictions must match one to one")
    judged = evaluation.judge(records, predictions)
    metrics = evaluation.decision_metrics(judged, ["stage"])
    return {
        "cases": judged,
        "metrics": metrics,
        "confusion": evaluation.confusion(judged, ["stage"]),
        "report": evaluation.report(metrics),
    }


def build_alignment_sets(cases: DataFrame, prompt: Column, out: str, seed: int = 42, train_ratio: float = 0.8) -> DataFrame:
    """Split cases, write SFT and DPO records as JSON lines by split, return the counts."""
    split = alignment.stratified_split(cases, seed=seed, train_ratio=train_ratio)
    sft, dpo = alignment.sft_records(split, prompt), alignment.dpo_records(split, prompt)
    for name, rows in (("sft", sft), ("dpo", dpo)):
        for part in ("train", "eval"):
            ingest.write_jsonl(rows.where(F.col("split") == part), f"{out}/{name}_{part}")
    return alignment.split_counts(split)
