"""Sparse, dense and fused retrieval over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS
from inkwell.functions import text as T
from inkwell.operators import dense as D
from inkwell.operators import retrieval as R
from inkwell.session import spread, table
from inkwell.workload import sqltext as S
from inkwell.workload.registry import register

K = DEFAULTS.candidate_limit
LIMIT = DEFAULTS.retrieval_limit


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as chunks; corpus order is the document id."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("pos"),
        F.col("text").alias("content"),
        F.col("source").alias("asset_id"),
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


DOC_SQL = "SELECT doc_id AS chunk_id, doc_id AS pos, text AS content FROM documents"
QUERY_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"
SEARCH = S.search_ctes(DOC_SQL, QUERY_SQL)


@register(
    "tokenize_stats",
    f"""SELECT doc_id, len({S.tokens('text')}) AS n_distinct, {S.token_count('text')} AS n_rough FROM documents""",
)
def tokenize_stats(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.size(T.tokenize(F.col("text"))).cast("bigint").alias("n_distinct"),
        T.token_count(F.col("text")).cast("bigint").alias("n_rough"),
    )


@register(
    "bm25_stats",
    f"""WITH {SEARCH} SELECT token, df, round(idf, 6) AS idf FROM idf""",
)
def bm25_stats(spark, sf):
    return R.temporary_index(document_chunks(spark, sf)).idf.select("token", "df", F.round("idf", 6).alias("idf"))


@register(
    "lexical_topk",
    f"""WITH {SEARCH}, hits AS ({S.top_k('overlap', K)})
    SELECT query_id, chunk_id, rank, score FROM hits""",
)
def lexical_topk(spark, sf):
    hits = R.lexical_search(benchmark_queries(spark, sf), document_chunks(spark, sf), K)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


@register(
    "bm25_topk",
    f"""WITH {SEARCH}, hits AS ({S.top_k('bm25', K)})
    SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits""",
)
def bm25_topk(spark, sf):
    hits = R.bm25_search(benchmark_queries(spark, sf), document_chunks(spark, sf), K)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


HYBRID = f"""{SEARCH},
    dense AS ({S.top_k('overlap', K)}),
    sparse AS ({S.top_k('bm25', K)}),
    {S.fusion_ctes(K)}"""


@register(
    "rrf_fusion",
    f"""WITH {HYBRID} SELECT query_id, chunk_id, fusion_rank, round(fusion_score, 6) AS fusion_score FROM fused""",
)
def rrf_fusion(spark, sf):
    pairs = R.best_pairs(benchmark_queries(spark, sf), document_chunks(spark, sf), K)
    fused = R.fuse(R.ranked_lists(pairs, K), K)
    return fused.select(
        "query_id",
        "chunk_id",
        F.col("fusion_rank").cast("bigint").alias("fusion_rank"),
        F.round("fusion_score", 6).alias("fusion_score"),
    )


@register(
    "hybrid_topk",
    f"""WITH {HYBRID}, hits AS ({S.reranked(LIMIT)})
    SELECT query_id, chunk_id, rank, 'C' || rank AS label, round(score, 4) AS score FROM hits""",
)
def hybrid_topk(spark, sf):
    hits = R.hybrid_search(benchmark_queries(spark, sf), document_chunks(spark, sf))
    return hits.select(
        "query_id",
        "chunk_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.concat(F.lit("C"), F.col("rank")).alias("label"),
        F.round("score", 4).alias("score"),
    )


def _scoped_sql() -> str:
    chunks = "SELECT doc_id AS chunk_id, doc_id AS pos, text AS content, source AS scope_id FROM documents"
    return f"""WITH chunk_in AS ({chunks}),
    query_in AS (SELECT item_id AS query_id, text AS query, 'src' || (item_id % 20) AS scope_id FROM benchmark),
    corpus AS (SELECT scope_id, chunk_id, pos, {S.fallback_tokens('content')} AS tokens FROM chunk_in),
    terms AS (SELECT query_id, scope_id, unnest({S.fallback_tokens('query')}) AS token FROM query_in),
    totals AS (SELECT scope_id, count(*) AS n, avg(len(tokens)) AS avg_len FROM corpus GROUP BY scope_id),
    postings AS (SELECT scope_id, chunk_id, pos, len(tokens) AS doc_len, unnest(tokens) AS token FROM corpus),
    raw_idf AS (SELECT scope_id, token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r
      FROM postings JOIN totals USING (scope_id) GROUP BY scope_id, token),
    means AS (SELECT scope_id, avg(r) AS m FROM raw_idf GROUP BY scope_id),
    idf AS (SELECT scope_id, token, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw_idf JOIN means USING (scope_id)),
    pairs AS (
      SELECT query_id, chunk_id, pos,
             round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS bm25
      FROM terms JOIN idf USING (scope_id, token) JOIN postings USING (scope_id, token) JOIN totals USING (scope_id)
      GROUP BY query_id, chunk_id, pos),
    hits AS ({S.top_k('bm25', K)})
    SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits"""


@register("scoped_bm25_topk", _scoped_sql())
def scoped_bm25_topk(spark, sf):
    """Each query searches one source; corpus statistics are those of the source."""
    docs = document_chunks(spark, sf)
    scopes = docs.select(F.col("asset_id").alias("scope_id"), "asset_id").distinct()
    queries = benchmark_queries(spark, sf).withColumn(
        "scope_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    )
    hits = R.bm25_search(queries, docs, K, scopes=scopes)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


CENTROIDS = """parts AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
    means AS (SELECT label, dim, avg(v) AS v FROM parts GROUP BY label, dim),
    cent AS (SELECT label, list(v ORDER BY dim) AS vector FROM means GROUP BY label)"""


def class_queries(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    return D.centroids(vectors, "label").withColumnRenamed("label", "query_id")


def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), "label"
    )


@register(
    "dense_topk",
    f"""WITH {CENTROIDS},
    scored AS (SELECT label AS query_id, vec_id AS chunk_id, vec_id AS pos,
      round(list_dot_product(vector, embedding::DOUBLE[]) /
        (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS score
      FROM cent, (SELECT vec_id, embedding FROM embeddings))
    SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM scored)
    WHERE rank <= {K}""",
)
def dense_topk(spark, sf):
    hits = D.dense_topk(class_queries(spark, sf), vector_table(spark, sf), K)
    return hits.select(
        F.col("query_id"), "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score")
    )


@register(
    "dense_sparse_fusion",
    f"""WITH {S.search_ctes(DOC_SQL, QUERY_SQL)},
    dscored AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, d.doc_id AS pos,
      round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) /
        (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) *
         sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 9) AS score
      FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id,
           documents d JOIN embeddings v ON v.vec_id = d.doc_id),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank
      FROM dscored) WHERE rank <= {K}),
    sparse AS ({S.top_k('bm25', K)}),
    {S.fusion_ctes(K)}
    SELECT query_id, chunk_id, fusion_rank, round(fusion_score, 6) AS fusion_score,
           round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score FROM fused""",
)
def dense_sparse_fusion(spark, sf):
    """Model-backed mode: cosine hits and BM25 hits fused. Vector ids stand for document and query ids."""
    docs = document_chunks(spark, sf)
    queries = benchmark_queries(spark, sf)
    vectors = vector_table(spark, sf)
    query_vectors = vectors.join(
        queries.select(F.col("query_id").alias("chunk_id")), "chunk_id"
    ).select(F.col("chunk_id").alias("query_id"), "vector")
    dense = D.dense_topk(query_vectors, vectors, K, scope=docs)
    sparse = R.bm25_search(queries, docs, K)
    fused = R.fuse(R.merge_ranked(dense, sparse), K)
    return fused.select(
        "query_id",
        "chunk_id",
        F.col("fusion_rank").cast("bigint").alias("fusion_rank"),
        F.round("fusion_score", 6).alias("fusion_score"),
        F.round("dense_score", 6).alias("dense_score"),
        F.round("sparse_score", 6).alias("sparse_score"),
    )
