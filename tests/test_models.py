"""Bayes with smoothing and neighbours as models: fit, search, probabilities, saving."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.operators import learn, models


def data(spark, n=240, task="classification"):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) * [1, 3, 0.2]
    label = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.2)
    rows = [(i, *map(float, x[i]), f"c{label[i]}" if task == "classification" else None, float(x[i] @ [1, 2, 3])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, label string, y double")
    return learn.prepare(df.drop("y"), "label", ["id"]) if task == "classification" else learn.prepare(df.drop("label"), "y", ["id"], task="regression")


def matrix(df):
    rows = df.orderBy("id").collect()
    return np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows]), np.array([getattr(r, "fold", -1) for r in rows])


def plain_bayes(x, y, test, smoothing):
    floor = smoothing * x.var(axis=0).max()
    scores = []
    for c in sorted(set(y)):
        own = x[y == c]
        v = own.var(axis=0) + floor
        scores.append(math.log(len(own) / len(x)) - 0.5 * (np.log(2 * np.pi * v).sum() + ((test - own.mean(axis=0)) ** 2 / v).sum(axis=1)))
    s = np.stack(scores, axis=1)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return s.argmax(axis=1), e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("smoothing", [1e-9, 0.7])
def test_bayes_equals_the_plain_form(spark, smoothing):
    d = data(spark)
    model = learn.fit(d, "NaiveBayes", {"var_smoothing": smoothing})
    x, y, _ = matrix(d.train)
    test, _, _ = matrix(d.test.select("id", "features", "label"))
    want, shares = plain_bayes(x, y, test, smoothing)
    got = model.transform(d.test).orderBy("id").collect()
    assert [r.prediction for r in got] == want.tolist()
    assert np.allclose([r.probability.toArray() for r in got], shares)


def test_bayes_scores_every_smoothing_at_once(spark):
    d = data(spark)
    values = [1e-9, 0.05, 2.0]
    found = learn.search(d, "NaiveBayes", [{"var_smoothing": v} for v in values])
    x, y, fold = matrix(d.train)
    for v, (_, score) in zip(values, found.tried):
        want = [(plain_bayes(x[fold != f], y[fold != f], x[fold == f], v)[0] == y[fold == f]).mean() for f in sorted(set(fold))]
        assert score == pytest.approx(np.mean(want))
    assert found.score == max(s for _, s in found.tried) and found.model.transform(d.test).count() == d.test.count()


def plain_neighbours(x, y, test, k, weights, task):
    out = []
    for t in test:
        d = np.sqrt(((x - t) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:k]
        w = np.ones(k) if weights == "uniform" else 1 / d[near]
        if task == "regression":
            out.append((w * y[near]).sum() / w.sum())
        else:
            votes = {c: w[y[near] == c].sum() for c in sorted(set(y))}
            out.append(min(votes, key=lambda c: (-votes[c], c)))
    return np.array(out)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_neighbours_are_fitted_searched_saved_and_loaded(spark, small_limits, tmp_path, task):
    d = data(spark, 200, task)
    x, y, fold = matrix(d.train)
    candidates = learn.combinations({"n_neighbors": [3, 6], "weights": ["uniform", "distance"]})
    found = learn.search(d, "KNN", candidates)
    for c, score in found.tried:
        want = []
        for f in sorted(set(fold)):
            p = plain_neighbours(x[fold != f], y[fold != f], x[fold == f], c["n_neighbors"], c["weights"], task)
            truth = y[fold == f]
            want.append((p == truth).mean() if task == "classification" else 1 - ((p - truth) ** 2).mean() / truth.var())
        assert score == pytest.approx(np.mean(want)), c
    learn.save(str(tmp_path / "m"), found.model, d)
    model, prep, meta = learn.load(spark, str(tmp_path / "m"))
    test, truth, _ = matrix(d.test.select("id", "features", "label"))
    want = plain_neighbours(x, y, test, found.params["n_neighbors"], found.params["weights"], task)
    for m in (found.model, model):
        got = m.transform(d.test).orderBy("id").collect()
        assert np.allclose([r.prediction for r in got], want)
        if task == "classification":
            assert all(abs(r.probability.toArray().sum() - 1) < 1e-9 and r.probability.toArray().argmax() == r.prediction for r in got)
    assert model.n_neighbors == found.params["n_neighbors"] and meta["task"] == task


def test_ranking_gives_probability_metrics(spark):
    d = data(spark, 150)
    grids = {"KNN": {"n_neighbors": [5]}, "NaiveBayes": {"var_smoothing": [1e-9]}, "LogisticRegression": {"C": [1]}}
    board, found = learn.train_ranked(d, list(grids), 2, grids)
    assert board.where("error is not null").isEmpty() and set(found) == set(grids)
    scores = learn.metrics(found["NaiveBayes"].model.transform(d.test), "classification")
    x, y, _ = matrix(d.train)
    test, truth, _ = matrix(d.test.select("id", "features", "label"))
    shares = plain_bayes(x, y, test, 1e-9)[1]
    assert scores["log_loss"] == pytest.approx(-np.log(np.clip(shares[np.arange(len(truth)), truth.astype(int)], 1e-15, 1 - 1e-15)).mean())
    areas, sizes = [], []
    for c in range(shares.shape[1]):
        up, down = shares[truth == c, c], shares[truth != c, c]
        areas.append(((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down)))
        sizes.append(len(up))
    assert scores["roc_auc"] == pytest.approx(np.average(areas, weights=sizes))
    curve = learn.validation_curve(d, "KNN", "n_neighbors", [3, 7])
    assert curve.count() == 2


def test_draws_are_seeded_and_inside_their_ranges(spark):
    for name, ranges in learn.RANGES.items():
        found = learn.draws(ranges, 200)
        assert found == learn.draws(ranges, 200) and found != learn.draws(ranges, 200, seed=1)
        for key, r in ranges.items():
            values = [f[key] for f in found]
            if "values" in r:
                assert set(values) == set(r["values"])
            else:
                assert r["low"] <= min(values) and max(values) <= r["high"] and len(set(values)) > 5
            if "step" in r:
                assert all(isinstance(v, int) for v in values)
            if r.get("log"):
                middle = math.sqrt(r["low"] * r["high"])
                assert 60 < sum(v < middle for v in values) < 140
    d = data(spark, 120)
    best = learn.range_search(d, "NaiveBayes", 6)
    assert len(best.tried) == 6 and best.params in learn.draws(learn.RANGES["NaiveBayes"], 6)


def test_wide_and_empty_classes(spark):
    rows = [(0.0, Vectors.dense(1.0, 2.0)), (0.0, Vectors.dense(1.5, 2.5)), (2.0, Vectors.dense(9.0, 9.0)), (2.0, Vectors.dense(8.0, 9.5))]
    df = spark.createDataFrame(rows, ["label", "features"])
    model = models.GaussianBayes(0.1, classes=4).fit(df)
    assert [r.prediction for r in model.transform(df).collect()] == [0.0, 0.0, 2.0, 2.0]
    near = models.NearestNeighbours(1, classes=3).fit(df)
    assert [r.prediction for r in near.transform(df).orderBy("label").collect()] == [0.0, 0.0, 2.0, 2.0]
    assert near.transform(df.limit(0)).count() == 0


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_equal_points_are_searched_once_and_score_as_before(spark, monkeypatch, task):
    rng = np.random.default_rng(11)
    rows = [(i % 3, float(rng.integers(0, 3)) if task == "classification" else float(rng.normal()), Vectors.dense(rng.integers(0, 5, 2).astype(float))) for i in range(900)]
    train = spark.createDataFrame(rows, ["fold", "label", "features"]).repartition(3).persist()
    train.count()
    candidates = [{"n_neighbors": 4, "weights": "uniform"}, {"n_neighbors": 7, "weights": "distance"}, {"n_neighbors": 1}]
    want = []
    for c in candidates:  # every setting as a fitted model
        scores = []
        for f in range(3):
            model = models.NearestNeighbours(c["n_neighbors"], c.get("weights", "uniform"), task, 3).fit(train.where(F.col("fold") != f))
            scores.append(learn._score(model, train.where(F.col("fold") == f), task))
        want.append(np.mean(scores))
    built, asked = [], []
    build, nearest = models.Index.build, models.Index.nearest
    monkeypatch.setattr(models.Index, "build", staticmethod(lambda df, keep=False: built.append(df.count()) or build(df, keep)))
    monkeypatch.setattr(models.Index, "nearest", lambda self, test, k, same=False: asked.append(test.count()) or nearest(self, test, k, same))
    assert models.neighbour_scores(train, candidates, task, 3) == pytest.approx(want, abs=1e-12)
    assert len(built) == 3 and max(built) <= 25 * 2 * 7 and max(asked) <= 25
