import pytest
from frames import big, clean as clean_frame, people
from pyspark.sql import functions as F

from tablewright.operators import clean, profile
from tablewright.sources import files, versions


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_detection(spark):
    df = people(spark)
    missing = rows(profile.missing_report(df))
    assert [(r["column_name"], r["missing"]) for r in missing] == [("score", 1)]
    assert profile.duplicate_twins(df).first()["duplicate_rows"] == 2
    assert profile.duplicate_extras(df).first()["extra_rows"] == 1
    wild = {r["column_name"]: r["outliers_iqr"] for r in rows(profile.outlier_report(df))}
    assert wild["salary"] >= 1
    assert "gender" in [r["column_name"] for r in rows(profile.encoding_candidates(df))]
    assert {"score", "salary"} <= {r["column_name"] for r in rows(profile.scaling_candidates(df))}


def test_nothing_to_do(spark):
    df = clean_frame(spark)
    assert profile.missing_report(df).count() == 0
    assert profile.duplicate_twins(df).first()["duplicate_rows"] == 0
    assert all(r["outliers_iqr"] == 0 for r in rows(profile.outlier_report(df)))
    assert profile.encoding_candidates(df).count() == 1


def test_larger_frame(spark):
    df = big(spark)
    assert [(r["column_name"], r["missing"]) for r in rows(profile.missing_report(df))] == [("x", 1)]
    assert profile.column_kinds(df) == {"x": "numeric", "y": "numeric", "cat": "categorical"}


def test_median_fills_one_cell(spark):
    out, stats = clean.impute(people(spark), "median", ["score"])
    assert stats["filled"] == 1
    assert [r["score"] for r in rows(out) if r["id"] == 4] == [8.2]
    assert out.where(F.col("score").isNull()).count() == 0


def test_dedup_then_again_changes_nothing(spark, tmp_path):
    df = people(spark)
    once, stats = clean.dedup(df)
    assert stats["removed"] == 1
    assert versions.write_version(df, once, stats, str(tmp_path), "people") == 2
    again, stats = clean.dedup(once)
    assert stats["removed"] == 0
    assert versions.write_version(once, again, stats, str(tmp_path), "people") is None
    assert versions.versions(spark, str(tmp_path), "people") == [2]


def test_cap_changes_one_cell(spark):
    out, stats = clean.outliers(people(spark), "cap", ["salary"])
    assert stats["cells_replaced"] == 1
    assert max(r["salary"] for r in rows(out)) < 999999
    _, stats = clean.outliers(people(spark), "remove", ["salary"])
    assert stats["rows_removed"] == 1


@pytest.fixture
def case_sensitive(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")  # M and m are different categories
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_one_hot_names(spark, case_sensitive):
    out, stats = clean.one_hot(people(spark), ["gender"])
    assert stats["new_columns"] == ["gender_F", "gender_M", "gender_Male", "gender_m"]
    assert "gender" not in out.columns
    out, stats = clean.one_hot(people(spark, gender_gap=True), ["gender"])
    assert stats["new_columns"][-1] == "gender_nan"
    assert sum(r["gender_nan"] for r in rows(out)) == 1


def test_one_hot_names_that_read_alike(spark):
    df = spark.createDataFrame([("a b",), ("a-b",), ("a+b",)], "k string")
    out, stats = clean.one_hot(df, ["k"])
    assert stats["new_columns"] == ["k_a_b", "k_a_b_2", "k_a_b_3"]
    assert all(sum(r.values()) == 1 for r in rows(out))


def test_one_hot_limit(spark):
    with pytest.raises(ValueError):
        clean.one_hot(big(spark).withColumn("k", F.col("x").cast("string")), ["k"])


def test_dummies_are_no_numbers(spark, case_sensitive):
    out, _ = clean.one_hot(people(spark), ["gender"])
    scaled, stats = clean.scale(out, "standard")
    assert not any(c.startswith("gender") for c in stats["old_ranges"])
    assert scaled.schema["gender_F"].dataType.simpleString() == "boolean"


def test_label_and_ordinal(spark):
    df = people(spark, gender_gap=True)
    codes = [r["gender"] for r in rows(clean.label_encode(df, ["gender"])[0].orderBy("id", "salary"))]
    assert sorted(codes) == [-1, 0, 0, 1, 2, 3]
    out, _ = clean.ordinal_encode(df, ["gender"], {"gender": ["F", "M"]})
    assert sorted((r["gender"] is None, r["gender"] or 0) for r in rows(out)) == [(False, 0.0), (False, 0.0), (False, 1.0), (True, 0), (True, 0), (True, 0)]


def test_standard_scaling(spark):
    out, _ = clean.scale(people(spark), "standard", ["salary"])
    got = out.agg(F.avg("salary").alias("m"), F.stddev_samp("salary").alias("s")).first()
    assert abs(got["m"]) < 1e-9 and abs(got["s"] - 1) < 1e-9
    constant = spark.createDataFrame([(1.0,), (1.0,)], "c double")
    assert clean.scale(constant, "minmax")[1]["skipped"] == {"c": "constant"}


def test_fill_needs_an_order(spark):
    with pytest.raises(ValueError):
        clean.impute(people(spark), "ffill", ["score"])


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    out, stats = clean.impute(df, "mean")
    assert stats["filled"] == 1 and sorted(r["v"] for r in rows(out)) == [1.0, 2.0, 3.0]


def test_export_formats(spark, tmp_path):
    df = people(spark)
    assert files.read_csv(spark, files.export(df, str(tmp_path / "a"), "csv")).count() == 6
    assert spark.read.parquet(files.export(df, str(tmp_path / "b"), "parquet")).count() == 6
    with pytest.raises(ValueError):
        files.export(df, str(tmp_path / "c"), "json")
    with pytest.raises(ValueError):
        files.export(df.limit(0), str(tmp_path / "d"), "csv")


def test_numbers_filled_with_text_become_text(spark):
    df = spark.createDataFrame([(1, 1.5, None), (2, None, None), (None, 2.0, None)], "a int, b double, c double")
    out, stats = clean.impute(df, "unknown")
    assert [tuple(r) for r in out.collect()] == [("1", "1.5", "unknown"), ("2", "unknown", "unknown"), ("unknown", "2.0", "unknown")]
    assert stats == {"before": 5, "after": 0, "filled": 5}
    assert dict(clean.impute(df, "constant", value="n/a")[0].dtypes)["b"] == "string"
    filled = clean.impute(df, "mode")[0]
    assert dict(filled.dtypes) == {"a": "int", "b": "double", "c": "string"} and filled.where("c <> 'unknown'").count() == 0


def test_ordinal_codes_of_many_values(spark):
    df = spark.range(700).selectExpr("id", "CASE WHEN id < 690 THEN concat('v', id % 300) END AS v", "id % 3 AS w")
    out, stats = clean.ordinal_encode(df, ["v", "w"], {"w": [2, 0]})
    rows = {r["id"]: r for r in out.collect()}
    order = sorted({f"v{k % 300}" for k in range(690)})
    assert all(rows[k]["v"] == float(order.index(f"v{k % 300}")) for k in range(690)) and rows[695]["v"] is None
    assert [rows[k]["w"] for k in range(3)] == [1.0, None, 0.0] and stats["values"] == {"v": 300}
