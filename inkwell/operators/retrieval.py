"""Sparse retrieval for a whole table of queries: overlap, BM25, fusion, rerank.

Shapes
------
chunks   ``chunk_id, pos, content`` (+ any payload); ``pos`` is corpus order and
         breaks every tie, so equal scores rank the same way in every run.
queries  ``query_id, query`` (+ ``scope_id`` when scopes are used).

Physical design
---------------
An index stores the token sets of the chunks, totals, inverse frequencies and
impact-ordered posting lists (``operators/postings.py``); texts are tokenised
when it is written and never by a search. A search reads the lists of its
tokens only, and of these only what can still reach a top-k; ``k`` rows per
part and query cross the network.

``pair_scores`` scores every pair that shares a token instead, for callers
that need all of them. It hashes the token sets once on ``bucket`` (a hash of
the chunk id). Exploding tokens, joining them with the query terms and adding
up scores run inside that one partitioning, so matched pairs are not
shuffled. A token held by a third of all chunks costs no more than its share
of each bucket. Query terms are broadcast only after a count shows that they
are few; larger query sets use a shuffled token join with salted hot tokens.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import text as T
from inkwell.operators import postings as P
from inkwell.session import checkpoint_root, shuffle_partitions, within_rows

# Okapi BM25 and rank-fusion constants.
K1 = 1.5
B = 0.75
IDF_FLOOR = 0.25
RRF_K = 60
SCORE_DIGITS = 9

GLOBAL_SCOPE = ""


def searchable(chunks: DataFrame) -> DataFrame:
    """Child chunks; a chunk with no level counts as a child."""
    if "chunk_level" not in chunks.columns:
        return chunks
    return chunks.where(F.coalesce(F.col("chunk_level"), F.lit("child")) == "child")


def in_scope(chunks: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Keep chunks of the assets named in ``scope(asset_id)``; no scope keeps everything."""
    if scope is None:
        return chunks
    return chunks.join(scope.select("asset_id").distinct(), "asset_id", "left_semi")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_count(chunks: DataFrame) -> int:
    """Four buckets per shuffle partition keep hashed partitions even."""
    return 4 * shuffle_partitions(chunks.sparkSession)


def tokenized(chunks: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """``bucket, scope_id, chunk_id, pos, tokens, doc_len, has_tokens`` of every searchable chunk.

    ``scopes(scope_id, asset_id)`` repeats a chunk once per scope that holds its
    asset, because corpus statistics differ per scope. Chunks may also bring
    their own ``scope_id``.
    """
    corpus = searchable(chunks)
    if scopes is None:
        if "scope_id" not in corpus.columns:
            corpus = corpus.withColumn("scope_id", F.lit(GLOBAL_SCOPE))
    else:
        corpus = corpus.join(scopes.select("scope_id", "asset_id").distinct(), "asset_id")
    raw = T.tokenize(F.col("content"))
    n = bucket_count(chunks)
    return (
        corpus.select("scope_id", "chunk_id", "pos", raw.alias("raw"), "content")
        .select(
            bucket_of(F.col("chunk_id"), n).alias("bucket"),
            "scope_id",
            "chunk_id",
            "pos",
            T.with_fallback(F.col("raw"), F.col("content")).alias("tokens"),
            (F.size("raw") > 0).alias("has_tokens"),
        )
        .withColumn("doc_len", F.size("tokens"))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per distinct query token: ``scope_id, query_id, token, query_has_tokens``."""
    if "scope_id" not in queries.columns:
        queries = queries.withColumn("scope_id", F.lit(GLOBAL_SCOPE))
    raw = T.tokenize(F.col("query"))
    return queries.select("scope_id", "query_id", "query", raw.alias("raw")).select(
        "scope_id",
        "query_id",
        (F.size("raw") > 0).alias("query_has_tokens"),
        F.explode_outer(T.with_fallback(F.col("raw"), F.col("query"))).alias("token"),
    )


def corpus_totals(corpus: DataFrame) -> DataFrame:
    """``scope_id, n_chunks, avg_len``."""
    return corpus.groupBy("scope_id").agg(
        F.count("*").alias("n_chunks"), F.avg("doc_len").alias("avg_len")
    )


def document_frequencies(corpus: DataFrame) -> DataFrame:
    """``scope_id, token, df``; partial counts are combined on the map side."""
    return (
        corpus.select("scope_id", F.explode_outer("tokens").alias("token"))
        .groupBy("scope_id", "token")
        .agg(F.count("*").alias("df"))
    )


def inverse_frequencies(corpus: DataFrame, totals: DataFrame) -> DataFrame:
    """``scope_id, token, df, idf`` with the floor for tokens in most chunks.

    Negative values become a quarter of the mean raw value of the scope.
    """
    n, df = F.col("n_chunks"), F.col("df")
    raw = F.log(n - df + 0.5) - F.log(df + 0.5)
    weighted = document_frequencies(corpus).join(totals, "scope_id").select("scope_id", "token", "df", raw.alias("raw_idf"))
    means = weighted.groupBy("scope_id").agg((F.lit(IDF_FLOOR) * F.avg("raw_idf")).alias("floor"))
    idf = F.when(F.col("raw_idf") < 0, F.col("floor")).otherwise(F.col("raw_idf"))
    return weighted.join(means, "scope_id").select("scope_id", "token", "df", idf.alias("idf"))


@dataclass(frozen=True)
class SearchIndex:
    """Stored token sets, totals per scope, inverse frequencies and posting lists; searches read these and no text."""

    corpus: DataFrame
    totals: DataFrame
    idf: DataFrame
    members: DataFrame
    postings: DataFrame


INDEX_TABLES = ("corpus", "totals", "idf", "members", "postings")


def write_index(chunks: DataFrame, path: str, scopes: DataFrame | None = None) -> SearchIndex:
    """Tokenises the chunks once and stores tokens, statistics and posting lists below ``path``."""

    def stored(rows: DataFrame, part: str) -> DataFrame:
        rows.write.mode("errorifexists").parquet(f"{path}/{part}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{part}")

    corpus = stored(tokenized(chunks, scopes), "corpus")
    totals = stored(corpus_totals(corpus), "totals")
    idf = stored(inverse_frequencies(corpus, totals), "idf")
    partitions = shuffle_partitions(corpus.sparkSession)
    numbered = stored(P.numbered_chunks(corpus, _length_factor(F.col("avg_len")), totals, partitions), "numbered")
    return SearchIndex(corpus, totals, idf, stored(P.member_rows(numbered), "members"), stored(P.posting_rows(numbered), "postings"))


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(*[spark.read.parquet(f"{path}/{part}") for part in INDEX_TABLES])


def temporary_index(chunks: DataFrame, scopes: DataFrame | None = None) -> SearchIndex:
    """Index of one job below the shared folder."""
    return write_index(chunks, f"{checkpoint_root(chunks.sparkSession).rstrip('/')}/inkwell/index-{uuid.uuid4().hex}", scopes)


def _weighted_terms(index: SearchIndex, terms: DataFrame, small: bool) -> DataFrame:
    """Query terms with idf; terms absent from the corpus drop out."""
    return index.idf.join(F.broadcast(terms) if small else terms, ["scope_id", "token"])


def _length_factor(avg_len: Column) -> Column:
    return F.lit(K1 + 1) / (1 + K1 * (1 - B + B * F.col("doc_len") / avg_len))


def _salted_matches(postings: DataFrame, terms: DataFrame, settings: Settings) -> DataFrame:
    """Shuffled token join. A token gets one salt per ``salt_rows`` postings, so no salt grows with the corpus."""
    spark = postings.sparkSession
    salts = F.ceil(F.col("df") / settings.salt_rows).cast("int")
    flagged = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    hot = terms.where(salts > 1).select("scope_id", "token", salts.alias("salts")).distinct()
    if within_rows(hot, settings.broadcast_max_rows):
        hot = F.broadcast(hot)
    marked = postings.join(hot, ["scope_id", "token"], "left")
    salted = marked.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    return salted.join(flagged, ["scope_id", "token", "salt"]).drop("salt").repartition(
        shuffle_partitions(spark), "bucket", "chunk_id"
    )


def pair_scores(
    queries: DataFrame,
    chunks: DataFrame | None,
    scopes: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    index: SearchIndex | None = None,
) -> DataFrame:
    """``bucket, query_id, chunk_id, pos, overlap, bm25`` for every pair sharing a token.

    With a stored ``index`` the chunks are not read; without one they are indexed for this search.
    """
    index = temporary_index(chunks, scopes) if index is None else index
    terms = query_terms(queries)
    small = within_rows(terms, settings.broadcast_max_rows)
    weighted = _weighted_terms(index, terms, small)
    corpus = index.corpus.repartition(shuffle_partitions(queries.sparkSession), "bucket")
    postings = corpus.join(index.totals.select("scope_id", "avg_len"), "scope_id").select(
        "bucket",
        "scope_id",
        "chunk_id",
        "pos",
        "has_tokens",
        _length_factor(F.col("avg_len")).alias("factor"),
        F.explode_outer("tokens").alias("token"),
    )
    if small:
        # idf keeps only query tokens, so this table is no larger than the counted terms.
        matches = postings.join(F.broadcast(weighted.drop("df")), ["scope_id", "token"])
    else:
        matches = _salted_matches(postings, weighted, settings)
    keys = ["bucket", "query_id", "chunk_id", "pos"] if small else ["bucket", "chunk_id", "query_id", "pos"]
    return matches.groupBy(*keys).agg(
        F.count_if(F.col("has_tokens") & F.col("query_has_tokens")).cast("double").alias("overlap"),
        F.round(F.sum(F.col("idf") * F.col("factor")), SCORE_DIGITS).alias("bm25"),
    ).select("bucket", "query_id", "chunk_id", "pos", "overlap", "bm25")


def best_pairs(
    queries: DataFrame, chunks: DataFrame | None, k: int, scopes: DataFrame | None = None, settings: Settings = DEFAULTS,
    index: SearchIndex | None = None, overlap: bool = True, bm25: bool = True,
) -> DataFrame:
    """``query_id, chunk_id, pos, overlap, bm25`` of every pair that can be among a query's ``k`` best by either score.

    Exact: the ranked lists equal those of ``pair_scores``. A score is 0 where the pair is no candidate by it.
    """
    index = temporary_index(chunks, scopes) if index is None else index
    terms = query_terms(queries)
    weighted = _weighted_terms(index, terms, within_rows(terms, settings.broadcast_max_rows)).drop("df")
    partitions = shuffle_partitions(queries.sparkSession)
    won = P.part_winners(index.members, index.postings, weighted, k, partitions, settings.broadcast_max_rows, overlap, bm25)
    return won.select(
        "query_id", "chunk_id", "pos", F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
        F.round(F.coalesce("bm25", F.lit(0.0)), SCORE_DIGITS).alias("bm25"),
    )


def _rank(partition: list[str], score: str) -> Column:
    return F.row_number().over(
        Window.partitionBy(*partition).orderBy(F.col(score).desc(), F.col("pos"), F.col("chunk_id"))
    )


def top_candidates(pairs: DataFrame, k: int, score: str, local: list[str] = ("bucket",)) -> DataFrame:
    """Top ``k`` positive scores per query: first within each group of ``local``, then overall."""
    hits = pairs.where(F.col(score) > 0)
    first = hits.withColumn("rank", _rank([*local, "query_id"], score)).where(F.col("rank") <= k) if local else hits
    return first.withColumn("rank", _rank(["query_id"], score)).where(F.col("rank") <= k)


def ranked_lists(pairs: DataFrame, k: int) -> DataFrame:
    """Both ranked lists in one pass: overlap side and BM25 side, ``k`` each; first within each bucket, if pairs have one."""
    if "bucket" in pairs.columns:
        pairs = (
            pairs.withColumn("dense_rank", _rank(["bucket", "query_id"], "overlap"))
            .withColumn("sparse_rank", _rank(["bucket", "query_id"], "bm25"))
            .where((F.col("dense_rank") <= k) | (F.col("sparse_rank") <= k))
        )
    return (
        pairs.withColumn("dense_rank", _rank(["query_id"], "overlap"))
        .withColumn("sparse_rank", _rank(["query_id"], "bm25"))
        .where((F.col("dense_rank") <= k) | (F.col("sparse_rank") <= k))
        .withColumn("dense_rank", F.when((F.col("overlap") > 0) & (F.col("dense_rank") <= k), F.col("dense_rank")))
        .withColumn("sparse_rank", F.when((F.col("bm25") > 0) & (F.col("sparse_rank") <= k), F.col("sparse_rank")))
        .where(F.col("dense_rank").isNotNull() | F.col("sparse_rank").isNotNull())
        .select(
            "query_id",
            "chunk_id",
            "pos",
            "dense_rank",
            "sparse_rank",
            F.when(F.col("dense_rank").isNotNull(), F.col("overlap")).otherwise(F.lit(0.0)).alias("dense_score"),
            F.when(F.col("sparse_rank").isNotNull(), F.col("bm25")).otherwise(F.lit(0.0)).alias("sparse_score"),
        )
    )


def merge_ranked(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Union of two ranked lists ``query_id, chunk_id, pos, score, rank`` as one row per chunk."""
    both = dense.select("query_id", "chunk_id", "pos", "rank", "score", F.lit("dense").alias("side")).unionByName(
        sparse.select("query_id", "chunk_id", "pos", "rank", "score", F.lit("sparse").alias("side"))
    )

    def of(side: str, col: str) -> Column:
        return F.when(F.col("side") == side, F.col(col))

    return both.groupBy("query_id", "chunk_id").agg(
        F.min("pos").alias("pos"),
        F.min(of("dense", "rank")).alias("dense_rank"),
        F.min(of("sparse", "rank")).alias("sparse_rank"),
        F.coalesce(F.max(of("dense", "score")), F.lit(0.0)).alias("dense_score"),
        F.coalesce(F.max(of("sparse", "score")), F.lit(0.0)).alias("sparse_score"),
    )


def _rrf(rank: str) -> Column:
    return F.when(F.col(rank).isNotNull(), 1.0 / (F.lit(float(RRF_K)) + F.col(rank))).otherwise(F.lit(0.0))


def fuse(lists: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion. Ties keep list order: dense hits first, then sparse-only hits."""
    scored = lists.withColumn(
        "fusion_score", F.round(_rrf("dense_rank") + _rrf("sparse_rank"), SCORE_DIGITS)
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("fusion_score").desc(),
        F.col("dense_score").desc(),
        F.col("sparse_score").desc(),
        F.col("dense_rank").asc_nulls_last(),
        F.col("sparse_rank").asc_nulls_last(),
        F.col("chunk_id"),
    )
    return scored.withColumn("fusion_rank", F.row_number().over(order)).where(F.col("fusion_rank") <= k)


def rerank_by_sum(fused: DataFrame, limit: int) -> DataFrame:
    """Deterministic rerank: fusion + dense + sparse; ties by fusion score, then fused order."""
    scored = fused.withColumn(
        "score",
        F.round(F.col("fusion_score") + F.col("dense_score") + F.col("sparse_score"), SCORE_DIGITS),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col("fusion_score").desc(), F.col("fusion_rank")
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rerank_by_model(fused: DataFrame, scores: DataFrame, limit: int, then_by: str = "fusion_score") -> DataFrame:
    """Rerank by scores a caller's model produced: ``scores(query_id, chunk_id, rerank_score)``."""
    scored = fused.join(scores, ["query_id", "chunk_id"]).withColumn("score", F.col("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col(then_by).desc(), F.col("fusion_rank")
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def lexical_search(
    queries: DataFrame, chunks: DataFrame | None, k: int, scopes: DataFrame | None = None, settings: Settings = DEFAULTS,
    index: SearchIndex | None = None,
) -> DataFrame:
    pairs = best_pairs(queries, chunks, k, scopes, settings, index, bm25=False)
    return top_candidates(pairs, k, "overlap", local=[]).select(
        "query_id", "chunk_id", "pos", "rank", F.col("overlap").alias("score")
    )


def bm25_search(
    queries: DataFrame, chunks: DataFrame | None, k: int, scopes: DataFrame | None = None, settings: Settings = DEFAULTS,
    index: SearchIndex | None = None,
) -> DataFrame:
    pairs = best_pairs(queries, chunks, k, scopes, settings, index, overlap=False)
    return top_candidates(pairs, k, "bm25", local=[]).select(
        "query_id", "chunk_id", "pos", "rank", F.col("bm25").alias("score")
    )


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame | None,
    limit: int | None = None,
    scopes: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Overlap and BM25 candidates, fused and reranked; ``limit`` hits per query."""
    limit = settings.retrieval_limit if limit is None else limit
    k = settings.candidates_for(limit)
    lists = ranked_lists(best_pairs(queries, chunks, k, scopes, settings, index), k)
    return rerank_by_sum(fuse(lists, k), limit)
