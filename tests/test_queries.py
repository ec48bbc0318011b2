"""Every registered query against its DuckDB text on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    diff = compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert diff in ("", "EMPTY"), diff


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_given_clusters_and_predictions_cover_all_rows(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    for name in ("cluster_kmeans", "cluster_hierarchical"):
        got = QUERIES[name](spark, FOLDER).toPandas()
        assert len(got) == rows and got["id"].is_unique
