"""Splits, folds and weights inside classes, however many and however large."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.operators import prep
from tablewright.plans import grouped


def position(key, seed=42):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16)


def ordered_ids(rows, seed=42):
    by = defaultdict(list)
    for i, label in rows:
        if label is not None:
            by[label].append((position(i, seed), i))
    return {g: [i for _, i in sorted(v)] for g, v in by.items()}


def uneven(n=900):
    return [(i, None if i % 50 == 7 else "hot" if i % 3 == 0 else f"c{i % 13}") for i in range(n)]


def test_splits_and_folds_equal_plain_versions(spark, small_limits):
    rows = uneven()
    df = spark.createDataFrame(rows, "id bigint, label string").repartition(5)
    by = ordered_ids(rows)
    split = {r.id: r.is_test for r in prep.split_stratified(df, ["id"], "label", 0.3).collect()}
    folds = {r.id: r.fold for r in prep.assign_folds(df, ["id"], 4, "label").collect()}
    assert len(split) == len(folds) == len(rows)
    for ids in by.values():
        take = min(max(int(0.3 * len(ids) + 0.5), 1), len(ids) - 1)
        assert [split[i] for i in ids] == [k < take for k in range(len(ids))]
        sizes = [len(ids) // 4 + (k < len(ids) % 4) for k in range(4)]
        assert [folds[i] for i in ids] == [k for k in range(4) for _ in range(sizes[k])]
    assert all(not split[i] and folds[i] is None for i, label in rows if label is None)


def test_fifty_thousand_classes(spark):
    df = spark.range(150_000).select("id", (F.col("id") % 50_000).alias("label"))
    split = prep.split_stratified(df, ["id"], "label")
    assert split.groupBy("label").agg(F.count_if("is_test").alias("t")).where("t <> 1").isEmpty()
    folds = prep.assign_folds(df, ["id"], 3, "label")
    assert folds.groupBy("label", "fold").count().where("count <> 1").isEmpty()
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "49999" not in plan
    weights = prep.class_weights(df, "label").agg(F.min("weight"), F.max("weight")).first()
    assert tuple(weights) == (1.0, 1.0)


def test_equal_places_are_cut_by_key(spark, small_limits):
    df = spark.createDataFrame([(i, "a") for i in range(100)] + [(i, "b") for i in range(100, 104)], "id bigint, label string")
    wanted = spark.createDataFrame([("a", 39, 100), ("a", 70, 100), ("b", 0, 4)], "_g string, _rank bigint, _size bigint")
    cuts = {r["_g"]: [c["_k0"] for c in r["_cuts"]] for r in grouped.grouped_cuts(df, "label", F.lit(5).cast("bigint"), ["id"], wanted).collect()}
    assert cuts == {"a": [39, 70], "b": [100]}


def test_rows_that_repeat_share_an_entry(spark):
    df = spark.createDataFrame([(1, "a")] * 6 + [(2, "a")] * 2, "id bigint, label string")
    wanted = spark.createDataFrame([("a", 5, 8), ("a", 6, 8)], "_g string, _rank bigint, _size bigint")
    (row,) = grouped.grouped_cuts(df, "label", F.col("id"), ["id"], wanted).collect()
    assert [c["_k0"] for c in row["_cuts"]] == [1, 2]


def test_split_falls_back_when_a_class_has_one_row(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "id bigint, label string")
    assert prep.split_stratified(df, ["id"], "label").where("is_test").count() == 2
    with pytest.raises(ValueError, match="more than"):
        prep.class_sizes(spark.range(2000).withColumn("label", F.col("id")), "label")
