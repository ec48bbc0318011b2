"""Categories by the million: positions from a table, sparse vectors by join and fold."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tablewright.operators import learn, prep
from tablewright.plans import ordered


def frame(spark):
    rows = [(i, None if i % 11 == 0 else float(i % 7), f"city {i % 90}", None if i % 13 == 0 else "xyz"[i % 3], f"name {(i * 7) % 300}") for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, amount double, city string, kind string, name string")


def plain(fitted, rows):
    """Feature vectors of rows, place by place."""
    out = {}
    pools = {c: sorted({r[c] for r in rows if r[c] is not None}) for c in fitted.categorical}
    for r in rows:
        vector = []
        for c, (fill, centre, spread) in fitted.numeric.items():
            vector.append(((fill if r[c] is None else r[c]) - centre) / spread)
        for c, (fill, _) in fitted.categorical.items():
            value = fill if r[c] is None else r[c]
            vector += [float(value == v) for v in pools[c]]
        out[r["id"]] = vector
    return out


@pytest.mark.parametrize("listed, broadcast", [(1000, 1_000_000), (60, 1_000_000), (60, 10)])
def test_vectors_equal_plain_ones(spark, monkeypatch, listed, broadcast):
    monkeypatch.setattr(prep, "LISTED", listed)
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ordered, "HOT_ROWS", 3)
    df = frame(spark)
    fitted = prep.fit_preparation(df, ["amount", "city", "kind", "name"], drop_id_text=False)
    assert fitted.sizes == {"city": 90, "name": 300} and fitted.unlisted == ([] if listed == 1000 else ["city", "name"])
    want = plain(fitted, df.collect())
    got = {r.id: r.features for r in fitted.vectors(df, ["id"]).collect()}
    assert all(np.allclose(got[i].toArray(), want[i]) for i in want) and len(fitted.feature_names) == len(want[1])
    unseen = fitted.vectors(df.withColumn("city", F.lit("nowhere")), ["id"]).first().features.toArray()
    assert unseen[1:91].sum() == 0 and unseen.sum() != 0
    made = fitted.transform(df, ["id"])
    if listed == 60:
        assert made.columns == ["id", "amount", "city", "kind_x", "kind_y", "kind_z", "name"]
        assert all(np.allclose(r.city.toArray(), want[r.id][1:91]) for r in made.collect())


@pytest.mark.parametrize("listed", [1000, 60])
def test_ordinal_codes(spark, monkeypatch, listed):
    monkeypatch.setattr(prep, "LISTED", listed)
    df = frame(spark)
    fitted = prep.fit_preparation(df, ["city", "kind"], "ordinal", drop_id_text=False)
    codes = {c: i for i, c in enumerate(sorted({f"city {k}" for k in range(90)}))}
    rows = {r.id: r for r in df.collect()}
    both = fitted.transform(df, ["id"]).join(fitted.vectors(df, ["id"]), "id").collect()
    for r in both:
        assert r.city == codes[rows[r.id].city] == r.features.toArray()[0] and r.kind == r.features.toArray()[1]
    assert fitted.transform(df.withColumn("city", F.lit("nowhere"))).agg(F.min("city"), F.max("city")).first()[:] == (-1.0, -1.0)


def test_a_million_categories_reach_a_model(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 100_000)
    df = spark.range(1_000_000).select("id", F.format_string("user %07d", (F.col("id") * 7919) % 1_000_000).alias("user"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    fitted = prep.fit_preparation(df, ["user"], drop_id_text=False)
    assert fitted.sizes == {"user": 1_000_000} and fitted.categorical["user"][1] is None
    rows = fitted.vectors(df, ["id", "y"])
    wrong = rows.where(F.col("id") % 50_000 == 17).collect()
    assert len(wrong) == 20 and all(r.features.size == 1_000_000 and r.features.indices.tolist() == [(r.id * 7919) % 1_000_000] for r in wrong)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "user 0000001" not in plan
    small = prep.fit_preparation(df.where("id < 3000"), ["user"], drop_id_text=False)
    vectors = small.vectors(df.where("id < 3000"), ["id", "y"])
    model = LogisticRegression(labelCol="y", maxIter=3).fit(vectors)
    data = learn.TrainingData("classification", "y", ["id"], vectors, vectors, small, [0.0, 1.0], 3000)
    learn.save(str(tmp_path / "m"), model, data)
    again, loaded, meta = learn.load(spark, str(tmp_path / "m"))
    assert loaded.categorical == small.categorical and loaded.sizes == {"user": 3000}
    scored = learn.batch_score(df.where("id < 3000"), ["id"], again, loaded, meta["classes"])
    assert scored.count() == 3000 and scored.where("prediction is null").isEmpty()


def test_the_place_of_a_category_is_read_without_filling_the_vector(spark):
    from pyspark.ml.linalg import SparseVector, Vectors

    # two billion places: a dense copy of one such vector would take 16 GB
    vectors = [SparseVector(2_000_000_000, {1_999_999_998: 1.0}), SparseVector(5, {1: 2.0, 3: 1.0}), SparseVector(5, {}), Vectors.dense([0.0, 1.0, 1.0]), Vectors.dense([0.0, 3.0])]
    df = spark.createDataFrame([*enumerate(vectors), (5, None)], ["id", "v"])
    got = {r.id: r.place for r in df.select("id", prep.first_place(F.col("v"), 1.0).alias("place")).collect()}
    assert got == {0: 1_999_999_999, 1: 4, 2: 0, 3: 2, 4: 0, 5: None}
