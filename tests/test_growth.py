"""Steps that have to grow no faster than their input, against plainer forms of them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import blocks, cluster, relational
from tablewright.plans import ordered


def plain_nearest(a, b, k, same):
    with np.errstate(all="ignore"):
        gaps = (a[:, None, :] - b[None, :, :]).reshape(-1, a.shape[1])
        d = np.sqrt(np.einsum("ij,ij->i", gaps, gaps)).reshape(len(a), len(b))  # equal distances round alike
    d[~np.isfinite(d)] = np.inf
    if same:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [(i, int(j)) for i, row in enumerate(order) for j in row if np.isfinite(d[i, j])]


@pytest.mark.parametrize("width", [2, 24])
@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("spread", [1.0, 1e-9])
def test_least_of_groups_bound_the_nearest(width, same, spread, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 4000)
    random = np.random.default_rng(5)
    b = np.round(random.normal(size=(700, width)), 1) * spread + 3
    b[100:140] = b[100]  # copies
    b[7], b[9, 1] = np.nan, np.inf
    a = b if same else b[::3].copy()
    ids = np.arange(len(b))
    assert min(blocks.GROUP, len(b) // (8 * 4)) > 1  # groups are looked at first
    i, j, _ = blocks.nearest_few(a, b, 4, blocks._own_pairs(ids, ids) if same else None)
    assert list(zip(i.tolist(), j.tolist())) == plain_nearest(a, b, 4, same)


def test_own_pairs_of_repeated_and_missing_ids():
    here, there = np.array([3.0, np.nan, 1.0, 3.0]), np.array([1.0, 2.0, 3.0, 3.0, np.nan])
    i, j = blocks._own_pairs(here, there)(0, 4)
    assert list(zip(i, j)) == [(0, 2), (0, 3), (2, 0), (3, 2), (3, 3)]
    i, j = blocks._own_pairs(np.array(["b", "a"], dtype=object), np.array(["a", "a"], dtype=object))(1, 2)
    assert list(zip(i, j)) == [(0, 0), (0, 1)]


def test_mixtures_fitted_together_are_those_of_mllib(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(3, 4)) * 6
    rows = [(n, (centres[n % 3] + random.normal(size=4)).tolist()) for n in range(600)]
    vectors = spark.createDataFrame(rows, "id bigint, point array<double>").select("id", array_to_vector("point").alias("features")).persist()
    found = cluster.fit_mixtures(vectors, [2, 3])
    for k, model in found.items():
        want = GaussianMixture(k=k, seed=42).fit(vectors)
        assert np.allclose(model.weights, want.weights, atol=1e-6)
        both = model.transform(vectors).select("id", F.col("prediction").alias("p")).join(want.transform(vectors), "id")
        assert both.where("p <> prediction").isEmpty()
    vectors.unpersist()


def test_mixtures_that_points_do_not_determine_are_missing(spark):
    vectors = spark.createDataFrame([(n, [1.0, 2.0]) for n in range(40)], "id bigint, point array<double>")
    assert cluster.fit_mixtures(vectors.select(array_to_vector("point").alias("features")), [2]) == {2: None}


@pytest.mark.parametrize("number", [0, 3, 19, 20, 25])
def test_a_deep_page_numbers_only_rows_around_it(spark, monkeypatch, number):
    monkeypatch.setattr(relational, "TOP_ROWS", 0)
    monkeypatch.setattr(ordered, "SPAN_SAMPLE", 3000)
    numbered, plain = [], ordered.row_numbers
    monkeypatch.setattr(ordered, "row_numbers", lambda *a, rows, **k: numbered.append(rows) or plain(*a, rows=rows, **k))
    n = F.col("id")
    df = spark.range(10_050).select(F.when(n % 50 > 0, F.pmod(n * 7919, F.lit(1009))).alias("a"), F.date_add(F.lit(dt.date(2020, 1, 1)), (n % 11).cast("int")).alias("d"), n.cast("string").alias("s"))
    keys = ["a", "d", "s"]
    got = relational.page(df, keys, number, 500)
    want = df.orderBy(*keys).offset(number * 500).limit(500)
    assert sorted(map(str, got.select(*keys).collect())) == sorted(map(str, want.collect()))
    assert {r["total"] for r in got.collect()} <= {10_050}
    assert numbered and max(numbered) < 5000


def test_a_sample_that_misleads_does_not_lose_a_page(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SPAN_SAMPLE", 1)
    df = spark.range(3000).select(F.col("id").alias("a"))
    for rows in (3000, 40_000):  # the second count is wrong, so the span is in the wrong place
        got = ordered.rows_between(df, ["a"], 1200, 1210, rows)
        assert sorted(r["a"] for r in got.collect()) == list(range(1200, 1210))


def test_a_series_makes_its_features_once(spark, monkeypatch):
    seen, split = [], cluster.split_temporal
    monkeypatch.setattr(cluster, "split_temporal", lambda made, order: seen.append(made) or split(made, order))
    df = spark.range(200).select("id", (F.col("id") % 13 + F.col("id") / 100).alias("x"))
    cluster.supervised_series(df, "x", ["id"]).collect()
    assert seen and "Window" not in seen[0]._jdf.queryExecution().toString()
