"""The registered queries against DuckDB, and the stages of the pipeline one by one."""

import hashlib

import cases
import pytest
from check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontaminate, jaccard
from tablewright.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    diff = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])
    assert diff == "", diff


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, FOLDER).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns and after.where("n_chars <> length(text)").count() == 0
        if k == 2:
            found = jaccard.join(after)
            assert found.where("component_id <> doc_id").count() == 0
        if k == 3:
            items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            left = decontaminate.mark(after, items).agg(F.sum("n_hit")).first()[0]
            assert left <= 20
        assert after.count() <= before
        docs, before = after, after.count()
    texts = {r.decoded_sha256 for r in docs.collect()}
    assert len(texts) <= before and all(r.n_tokens == len(r.ids) for r in docs.collect())


def test_stages_take_awkward_tables(spark, tmp_path):
    docs = cases.with_clashes(cases.awkward(spark))
    labels = [(k, int(k % 10 > 0), int(k % 10 == 1)) for k in range(60)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", "w1 w2 w3"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), str(tmp_path))
        after = stage(spark, docs, str(tmp_path)).cache()
        assert empty.count() == 0 and 0 < after.count() <= docs.count()
        if k < 4:
            assert after.columns == docs.columns and after.where("share <> 'own share' OR kept <> 'own kept'").count() == 0
        docs = after


def test_run_equals_the_stages(spark):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert {r.doc_id: r.ids_sha256 for r in docs.collect()} == got
    assert all(len(x) == len(hashlib.sha256().hexdigest()) for x in got.values())


def test_copies_of_a_clean_document_keep_their_lines(spark):
    clean = "A first line.\nA second one.\nfooter"
    rows = [(k, clean if k % 3 == 0 else f"page {k}\nown {k}\nfooter", "en", "s", 1) for k in range(30)] + [(30, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, cases.DOCS)
    after = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, FOLDER).collect()}
    assert after == {k: t and t.removesuffix("\nfooter") for k, t, *_ in rows}
