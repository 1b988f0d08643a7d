"""The registry, and a sample of queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SAMPLE = ["hybrid_topk", "dense_topk", "context_pick", "fact_upsert", "rewrite_variants", "route_turns", "quality_score", "upload_completeness", "decision_cases"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 70


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = db.execute(entry.oracle_sql()[name])
    assert cells(df.columns, [tuple(r) for r in df.collect()]) == cells([c[0] for c in cur.description], cur.fetchall())
