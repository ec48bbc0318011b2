"""Softmax boosting against a plain version that looks at every border of every feature."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.operators import boosting, learn


def table(spark, n=260, values=9):
    rng = np.random.default_rng(12)
    x = rng.integers(0, values, size=(n, 3)).astype(float)
    label = np.where(x[:, 0] + rng.normal(size=n) > 5, 2, np.where(x[:, 1] > 4, 1, 0))
    rows = [(i, float(y), Vectors.dense(v)) for i, (y, v) in enumerate(zip(label, x))]
    return x, label, spark.createDataFrame(rows, ["id", "label", "features"]).repartition(3)


def plain_tree(x, r, h, k, depth, leaf, at=0, out=None):
    out = {} if out is None else out
    value = (k - 1) / k * r.sum() / h.sum() if h.sum() > 1e-150 else 0.0
    best = None
    if depth and len(x) >= 2 * leaf:
        for j in range(x.shape[1]):
            for b in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= b
                if min(left.sum(), (~left).sum()) < leaf:
                    continue
                gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
                if gain > 1e-12 * len(x) and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, b)
    if best is None:
        return lambda t: np.full(len(t), value)
    _, j, b = best
    left = x[:, j] <= b
    low = plain_tree(x[left], r[left], h[left], k, depth - 1, leaf)
    high = plain_tree(x[~left], r[~left], h[~left], k, depth - 1, leaf)
    return lambda t: np.where(t[:, j] <= b + 0.25, low(t), high(t))


def plain(x, y, k, rounds, rate, depth, leaf):
    scores = np.tile(np.log([(y == c).mean() for c in range(k)]), (len(x), 1))
    losses = []
    for _ in range(rounds):
        p = boosting.softmax(scores)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        for c in range(k):
            r = (y == c) - p[:, c]
            scores[:, c] += rate * plain_tree(x, r, np.abs(r) * (1 - np.abs(r)), k, depth, leaf)(x)
    return boosting.softmax(scores), losses


@pytest.mark.parametrize("depth, leaf, refresh, at_once", [(1, 1, 10, 10**6), (2, 5, 2, 100)])
def test_equals_the_plain_version(spark, monkeypatch, tmp_path, depth, leaf, refresh, at_once):
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "SUMS_AT_ONCE", at_once)
    x, y, df = table(spark)
    model = boosting.SoftmaxBoosting(5, 0.3, depth, min_leaf=leaf, classes=3).fit(df)
    want, _ = plain(x, y, 3, 5, 0.3, depth, leaf)
    got = model.transform(df).orderBy("id").collect()
    assert np.allclose([r.probability.toArray() for r in got], want, atol=1e-9)
    assert [r.prediction for r in got] == want.argmax(axis=1).tolist()
    importance = model.featureImportances.toArray()
    assert importance.sum() == pytest.approx(1) and importance[2] < importance[0]
    model.write().save(str(tmp_path / "m"))
    again = boosting.SoftmaxBoostingModel.load(str(tmp_path / "m")).transform(df).orderBy("id").collect()
    assert [r.rawPrediction for r in again] == [r.rawPrediction for r in got]


def test_log_loss_falls_every_round(spark):
    x, y, df = table(spark, 400, 200)  # more values than bins
    model = boosting.SoftmaxBoosting(12, 0.2, 3, classes=3).fit(df)
    losses = []
    for n in range(0, 13, 2):
        part = boosting.SoftmaxBoostingModel(model.start, model.rate, model.rounds[:n], model.gains, model.width)
        losses.append(learn._probability_metrics(part.transform(df))["log_loss"])
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.8 * losses[0]


def test_subsampling_and_missing_classes(spark):
    x, y, df = table(spark)
    model = boosting.SoftmaxBoosting(6, 0.3, 2, subsample=0.5, classes=4).fit(df)
    shares = [r.probability.toArray() for r in model.transform(df).collect()]
    assert max(s[3] for s in shares) < 1e-6
    assert model.transform(df).where(F.col("prediction") == F.col("label")).count() > 0.7 * len(x)


def test_search_and_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), "xyz"[int(a > 0) + int(b > 0.5)]) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    data = learn.prepare(spark.createDataFrame(rows, "id bigint, a double, b double, label string"), "label", ["id"])
    found = learn.search(data, "GradientBoosting", [{"n_estimators": 2, "max_depth": 1}, {"n_estimators": 6, "max_depth": 2, "learning_rate": 0.4}])
    assert found.params["max_depth"] == 2 and isinstance(found.model, boosting.SoftmaxBoostingModel)
    learn.save(str(tmp_path / "m"), found.model, data)
    model, prep, meta = learn.load(spark, str(tmp_path / "m"))
    scored = learn.batch_score(spark.createDataFrame(rows, "id bigint, a double, b double, label string"), ["id"], model, prep, meta["classes"])
    assert scored.count() == 150 and {r.prediction for r in scored.collect()} <= set("xyz")


def test_rounds_scan_equal_rows_once(spark, monkeypatch):
    x, y, df = table(spark, 1200, 7)  # 343 different points
    written, plain_durable = [], boosting.durable
    monkeypatch.setattr(boosting, "durable", lambda frame: written.append(plain_durable(frame)) or written[-1])
    monkeypatch.setattr(boosting, "FOLD_ROWS", 50)
    model = boosting.SoftmaxBoosting(12, 0.3, 2, classes=3).fit(df)
    scanned, kinds = [w.count() for w in written if "scores" in w.columns], {(*p, c) for p, c in zip(x.tolist(), y.tolist())}
    assert len(kinds) < 700 and scanned == [len(kinds)] * 2
    want, _ = plain(x, y, 3, 12, 0.3, 2, 1)
    assert np.allclose([r.probability.toArray() for r in model.transform(df).orderBy("id").collect()], want, atol=1e-9)


def test_remembered_cells_score_as_the_trees_do(spark, monkeypatch):
    x, y, df = table(spark, 500, 100)
    model = boosting.SoftmaxBoosting(6, 0.3, 3, classes=3).fit(df)
    shape = boosting._Shape(model.start, model.rate, model.rounds, model.width)
    assert {j for j, _ in shape.borders()} == set(model.gains)
    rng = np.random.default_rng(1)
    batches = [rng.uniform(-5, 110, size=(n, 3)).round(rng.integers(0, 2)) for n in (40, 1, 200, 0, 90)]
    batches[0][3, 1], batches[2][5, 0] = np.nan, np.inf
    for kept in (10, 100, 10**6):
        monkeypatch.setattr(boosting, "CELLS_KEPT", kept)
        for batch, got in zip(batches, shape.scored(iter(batches))):
            assert (got == shape.scores(batch)).all()
