"""The shared building blocks against pandas, with limits so small that every large-data path runs."""

import numpy as np
import pytest
from frames import skewed
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.plans import ordered, selection, wide
from tablewright.plans.counts import categories, distinct_counts, modes

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("column", ["value", "tied", "key"])
def test_quantiles_are_exact(spark, small_limits, column):
    df = skewed(spark)
    got = selection.quantiles(df, {column: (F.col(column), LEVELS)})[column]
    assert np.allclose(got, df.toPandas()[column].quantile(LEVELS))


def test_quantiles_of_gaps_and_nothing(spark, small_limits):
    df = skewed(spark).withColumn("none", F.lit(None).cast("double"))
    got = selection.quantiles(df, {"gap": (F.col("gap"), [0.5]), "none": (F.col("none"), [0.5])})
    assert got["gap"][0] == pytest.approx(df.toPandas()["gap"].median())
    assert got["none"] == [None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5) | st.integers(-(10**12), 10**12), min_size=1, max_size=60), q=st.floats(0, 1))
def test_quantile_property(spark, values, q):
    limit, selection.EXACT_ROWS = selection.EXACT_ROWS, 3
    try:
        df = spark.createDataFrame([(v,) for v in values], "v bigint")
        got = selection.quantiles(df, {"v": (F.col("v"), [q])})["v"][0]
    finally:
        selection.EXACT_ROWS = limit
    assert got == pytest.approx(float(np.quantile(np.array(values, dtype="float64"), q)), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("k", [0, 1, 999, 2999, 3000])
def test_first_rows(spark, small_limits, k):
    df = skewed(spark)
    got = df.where(selection.first_rows_bound(df, [F.col("tied"), F.col("id")], k)).toPandas()
    want = df.toPandas().sort_values(["tied", "id"]).head(k)
    assert sorted(got["id"]) == sorted(want["id"])


def test_row_numbers(spark, small_limits):
    df = skewed(spark)
    whole = ordered.row_numbers(df, ["at", "id"]).toPandas().sort_values(["at", "id"])
    assert list(whole["row_number"]) == list(range(1, 3001))
    part = ordered.row_numbers(df, ["at", "id"], partition_by=["key"]).toPandas().sort_values(["key", "at", "id"])
    assert (part["row_number"].values == part.groupby("key").cumcount().values + 1).all()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, small_limits, descending):
    df = skewed(spark)
    got = ordered.running_sums(df, ["at", "id"], {"total": F.col("id")}, descending, ["key"]).toPandas()
    got = got.sort_values(["key", "at", "id"], ascending=not descending)
    assert (got["total"].values == got.groupby("key")["id"].cumsum().values).all()


def test_windows_over_hot_keys(spark, small_limits):
    df = skewed(spark)
    got = ordered.windowed(
        df, ["key"], ["at", "id"], lambda w: {"back": F.lag("value", 7).over(w), "ahead": F.lead("value", 2).over(w)}, 7, 2
    ).toPandas()
    assert len(got) == 3000
    got = got.sort_values(["key", "at", "id"])
    for name, step in (("back", 7), ("ahead", -2)):
        want = got.groupby("key")["value"].shift(step)
        assert np.allclose(got[name].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_fill_over_hot_keys(spark, small_limits, forward, keys):
    df = skewed(spark)
    got = ordered.fill(df, ["gap"], ["at", "id"], keys, forward).toPandas().sort_values(["at", "id"])
    want = df.toPandas().sort_values(["at", "id"])
    source = want.groupby(keys)["gap"] if keys else want["gap"]
    assert np.allclose(got["gap"], source.ffill() if forward else source.bfill(), equal_nan=True)


def test_ranks(spark, small_limits):
    df = skewed(spark)
    got = ordered.ranks(df, "tied").toPandas()
    assert (got["rank"] == got["tied"].rank(method="min", ascending=False)).all()
    assert (got["dense_rank"] == got["tied"].rank(method="dense", ascending=False)).all()


@pytest.mark.parametrize("small", [False, True])
def test_ranks_keep_rows_without_value(spark, small, request):
    if small:
        request.getfixturevalue("small_limits")
    df = skewed(spark)
    got = ordered.ranks(df, "gap").toPandas()
    assert len(got) == 3000
    known = got[got["gap"].notna()]
    assert (known["rank"] == known["gap"].rank(method="min", ascending=False)).all()
    assert set(got[got["gap"].isna()]["rank"]) == {len(known) + 1}


def test_join_back_left_keeps_all_rows(spark, small_limits):
    df = skewed(spark)
    lookup = df.where("key < 50").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = ordered.join_back(df, lookup, ["key"], "n", "left").toPandas()
    want = df.toPandas().merge(lookup.toPandas(), on="key", how="left")
    assert len(got) == 3000 and got["top"].sum() == want["top"].sum() and got["top"].isna().sum() == want["top"].isna().sum()


def test_counts(spark):
    df = skewed(spark)
    p = df.toPandas()
    assert distinct_counts(df, ["key", "tied", "gap"]) == {c: p[c].nunique() for c in ("key", "tied", "gap")}
    assert modes(df, ["key", "tied"]) == {c: p[c].mode()[0] for c in ("key", "tied")}
    with pytest.raises(ValueError):
        categories(df, "key", 10)


def test_fetch_splits_wide_tables(spark, monkeypatch):
    monkeypatch.setattr(wide, "AGGREGATES_PER_SCAN", 2)
    got = wide.fetch(skewed(spark), {f"s{i}": F.sum(F.col("id") * i) for i in range(5)})
    assert got == {f"s{i}": i * 3000 * 2999 // 2 for i in range(5)}
