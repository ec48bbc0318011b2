import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import relational as rel
from tablewright.sources import files


def test_view_names():
    assert files.view_name("2024 sales.csv") == "t_2024_sales"
    assert files.view_name("iris.csv") == "iris"
    assert files.view_name("a-b.c.parquet") == "a_b_c"


def test_json_lines_and_array(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    for name in ("l.json", "a.json"):
        assert [r.asDict() for r in files.load(spark, str(tmp_path / name)).orderBy("a").collect()] == rows


def test_names_are_trimmed(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a , b\n1, two\n")
    df = files.load(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["a", "b"] and df.first()["b"] == "two"


def test_jdbc_reads_in_ranges():
    got = files.jdbc_options("jdbc:x", "select * from t", "id", (0, 100), 4)
    assert got["dbtable"] == "(select * from t) q" and got["numPartitions"] == "4"
    assert files.jdbc_options("jdbc:x", "t", None, None, 4) == {"url": "jdbc:x", "dbtable": "t"}
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x", "t", "id", None, 4)


def test_pages_do_not_overlap(spark):
    df = spark.range(120).withColumn("v", F.col("id") * 2)
    first, second = (rel.page(df, ["id"], n, 50).toPandas() for n in (0, 1))
    assert not set(first["id"]) & set(second["id"]) and set(first["total"]) == {120}
    assert rel.page(df, ["id"], 0, 50, cap=60).first()["truncated"]


def test_visibility(spark):
    sets = spark.createDataFrame(
        [(1, None, "upload"), (2, 7, "upload"), (3, 8, "sample"), (4, 8, "upload"), (5, 8, "upload"), (6, 8, "upload")],
        "id bigint, owner_id bigint, source string",
    )
    shares = spark.createDataFrame([(4, 7, None), (5, None, "Me@X.org"), (5, 7, None), (6, 9, "you@x.org")], "dataset_id bigint, shared_with_user_id bigint, shared_with_email string")
    got = rel.visible_datasets(sets, shares, 7, "me@x.ORG").orderBy("id").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5]


def test_missing_features(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, z double")
    with pytest.raises(ValueError, match="b"):
        rel.align_columns(df, ["a", "b"])
    out, report = rel.align_columns(df, ["a", "b"], missing="zero")
    assert out.first().asDict() == {"a": 1.0, "b": 0.0} and report == {"missing": ["b"], "dropped": ["z"]}


@pytest.mark.parametrize("n,k", [(1000, 300), (300, 300), (301, 300), (7, 3), (5, 1), (1000, 999)])
def test_even_sample(spark, small_limits, n, k):
    import numpy as np

    got = sorted(r["id"] for r in rel.sample_evenly(spark.range(n), ["id"], k).collect())
    want = sorted(set((np.arange(k) * (n - 1) // max(k - 1, 1)).tolist())) if n > k else list(range(n))
    assert got == want
