import pytest
from frames import messy

from tablewright.operators import features


def test_untouched_columns_keep_gaps(spark):
    out, info = features.engineer(messy(spark), [{"type": "polynomial", "columns": ["tenure"], "degree": 2}])
    assert info["generated"] == ["tenure^2"]
    assert out.where("age IS NULL").count() == 1
    assert sorted(r["tenure^2"] for r in out.collect()) == [float(i * i) for i in range(1, 9)]


def test_touched_columns_are_filled(spark):
    out, info = features.engineer(messy(spark), [{"type": "interaction", "columns": ["age", "balance"]}])
    assert out.where("age IS NULL OR age_x_balance IS NULL").count() == 0
    assert any("median" in w for w in info["warnings"])


@pytest.mark.parametrize("op", [{"type": "magic", "columns": ["age"]}, {"type": "log", "columns": ["nope"]}, {"type": "sqrt", "columns": ["region"]}])
def test_nothing_generated_is_an_error(spark, op):
    with pytest.raises(features.FeatureError):
        features.engineer(messy(spark), [op])


def test_every_suggestion_works(spark):
    for s in features.suggest(messy(spark)).collect():
        features.engineer(messy(spark), [{"type": s["type"], "columns": s["columns"].split(",")}])


def test_bins_and_constant_column(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in range(11)], "v double, c double")
    out, _ = features.engineer(df, [{"type": "bin", "columns": ["v", "c"], "n_bins": 5}])
    got = out.orderBy("v").collect()
    assert [r["v_binned"] for r in got] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert {r["c_binned"] for r in got} == {2}
