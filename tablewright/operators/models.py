"""Models that MLlib lacks, with its interface: ``fit``, ``transform``, ``write().save`` and ``load``.

``GaussianBayes`` has a closed form, ``NearestNeighbours`` keeps an index of the training rows. Both score all their candidate
settings from shared work: one scan of sums per fold for Bayes, one search for the most neighbours per fold here.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import NaiveBayesModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import Identifiable
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.operators.blocks import Index
from tablewright.plans.durable import durable

SMOOTHING = 1e-9
NEIGHBOURS = 5


# --- Gaussian Bayes ---------------------------------------------------------------------------------


@dataclass
class Moments:
    """Rows, means and squared deviations of the features."""

    n: int
    mean: np.ndarray
    m2: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.m2 + other.m2 + gap * gap * (self.n * other.n / n))


def _added(parts: Sequence[Moments]) -> Moments:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def moments(df: DataFrame, *by: str) -> dict[tuple, Moments]:
    """Moments of ``features`` for every (by..., label), from one scan."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s")
    out = {}
    for r in df.groupBy(*by, "label").agg(summary).collect():  # one row per class and fold
        n = r["s"]["count"]
        out[tuple(r[c] for c in (*by, "label"))] = Moments(n, r["s"]["mean"].toArray(), r["s"]["variance"].toArray() * (n - 1))
    return out


@dataclass
class Normals:
    """Prior, mean and variance of every class; classes without rows have a prior of minus infinity."""

    prior: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    @staticmethod
    def of(classes: Mapping[int, Moments], count: int, smoothing: float) -> Normals:
        whole = _added(list(classes.values()))
        floor = smoothing * float((whole.m2 / whole.n).max())
        width = len(whole.mean)
        prior, mean, variance = np.full(count, -np.inf), np.zeros((count, width)), np.ones((count, width))
        for c, m in classes.items():
            prior[c], mean[c], variance[c] = np.log(m.n / whole.n), m.mean, np.maximum(m.m2 / m.n, 0) + floor
        return Normals(prior, mean, variance)

    def predict(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = [p - 0.5 * (np.log(v).sum() + ((x - m) ** 2 / v).sum(axis=1)) for p, m, v in zip(self.prior, self.mean, self.variance)]
        return np.argmax(np.stack(scores, axis=1), axis=1)


class GaussianBayes(Estimator):
    """Gaussian Bayes in closed form; ``var_smoothing`` times the largest variance of a feature is added to all variances.

    The fitted model is MLlib's own, so it scores and saves as such.
    """

    def __init__(self, var_smoothing: float = SMOOTHING, classes: int = 2):
        super().__init__()
        self.var_smoothing, self.classes = float(var_smoothing), classes

    def _fit(self, df: DataFrame) -> NaiveBayesModel:
        found = {int(k[0]): m for k, m in moments(df).items()}
        return bayes_model(df.sparkSession, Normals.of(found, max(self.classes, max(found) + 1), self.var_smoothing))


def bayes_model(spark: SparkSession, normals: Normals) -> NaiveBayesModel:
    """An MLlib model of given classes; a class without rows gets a prior that no score makes up for."""
    matrix = lambda m: DenseMatrix(m.shape[0], m.shape[1], m.ravel(order="F").tolist())
    sc = spark.sparkContext
    uid = f"{NaiveBayesModel.__name__}_{Identifiable().uid.rsplit('_', 1)[-1]}"
    prior = np.maximum(normals.prior, -1e300)
    parts = [_py2java(sc, x) for x in (DenseVector(prior), matrix(normals.mean), matrix(normals.variance))]
    made = sc._jvm.org.apache.spark.ml.classification.NaiveBayesModel(uid, *parts)
    made.set(made.getParam("modelType"), "gaussian")
    model = NaiveBayesModel(made)
    model._resetUid(uid)
    model._transfer_params_from_java()
    return model


def bayes_scores(train: DataFrame, values: Sequence[float], classes: int) -> list[float]:
    """Mean over the folds of the accuracy of every smoothing value: one scan for the moments, one for all scores."""
    found = moments(train, "fold")
    folds = sorted({f for f, _ in found})
    rules: dict[int, list[Normals]] = {}
    for f in folds:
        rest: dict[int, list[Moments]] = {}
        for (g, label), m in found.items():
            if g != f:
                rest.setdefault(int(label), []).append(m)
        rules[f] = [Normals.of({c: _added(parts) for c, parts in rest.items()}, classes, v) for v in values]

    def score(batches):
        for batch in batches:
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else None
            for f in np.unique(fold):
                mine = fold == f
                hits = [int((rule.predict(x[mine]) == label[mine]).sum()) for rule in rules[int(f)]]
                yield pa.RecordBatch.from_arrays([pa.array([int(f)], type=pa.int32()), pa.array([int(mine.sum())]), pa.array([hits], type=pa.list_(pa.int64()))], names=["fold", "n", "hits"])

    rows = train.select(F.col("fold").cast("int"), "label", vector_to_array("features").alias("x")).mapInArrow(score, "fold int, n bigint, hits array<bigint>")
    sums = rows.groupBy("fold").agg(F.sum("n").alias("n"), *[F.sum(F.col("hits")[i]).alias(f"h{i}") for i in range(len(values))]).collect()
    return [float(np.mean([r[f"h{i}"] / r["n"] for r in sums])) for i in range(len(values))]


# --- nearest neighbours -----------------------------------------------------------------------------


def _weighted(found: DataFrame, weights: str) -> DataFrame:
    """Neighbours with ``w``: one, or one over the distance, where exact matches silence the others."""
    if weights != "distance":
        return found.withColumn("w", F.lit(1.0))
    hit = F.min("distance").over(Window.partitionBy("test_id")) == 0
    return found.withColumn("w", F.when(hit, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))


def voted(found: DataFrame, task: str, weights: str = "uniform") -> DataFrame:
    """(test_id, prediction, votes) of neighbours; ``votes`` (label, share) are empty for values. Ties go to the smaller label."""
    found = _weighted(found, weights)
    if task == "regression":
        mean = F.sum(F.col("w") * F.col("label")) / F.sum("w")
        return found.groupBy("test_id").agg(mean.alias("prediction"), F.array().cast("array<struct<label: double, w: double>>").alias("votes"))
    votes = found.groupBy("test_id", "label").agg(F.sum("w").alias("w"))
    best = F.min(F.struct((-F.col("w")).alias("w"), F.col("label")))["label"]
    return votes.groupBy("test_id").agg(best.alias("prediction"), F.collect_list(F.struct(F.col("label").cast("double").alias("label"), F.col("w"))).alias("votes"))


class NearestNeighbours(Estimator):
    """Keeps the training rows as an index; of equally distant rows the one that was stored first is nearer."""

    def __init__(self, n_neighbors: int = NEIGHBOURS, weights: str = "uniform", task: str = "classification", classes: int = 2):
        super().__init__()
        if weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights {weights!r}")
        self.n_neighbors, self.weights, self.task, self.classes = int(n_neighbors), weights, task, classes

    def _fit(self, df: DataFrame) -> NeighboursModel:
        rows = df.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("point"), F.col("label").cast("double"))
        rows = durable(rows)  # the ids have to stay
        return NeighboursModel(Index.build(rows, keep=True), self.n_neighbors, self.weights, self.task, self.classes)


class NeighboursModel(Transformer):
    """Votes or means of the nearest rows of the index."""

    def __init__(self, index: Index, n_neighbors: int, weights: str, task: str, classes: int):
        super().__init__()
        self.index, self.n_neighbors, self.weights, self.task, self.classes = index, n_neighbors, weights, task, classes

    def neighbours(self, df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The rows of ``df`` numbered by ``_probe`` and written, and their neighbours (test_id, distance, label, place)."""
        rows = durable(df.withColumn("_probe", F.monotonically_increasing_id()))
        probes = rows.select(F.col("_probe").alias("id"), vector_to_array("features").alias("point"))
        return rows, self.index.nearest(probes, k)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows, found = self.neighbours(df, self.n_neighbors)
        votes = voted(found, self.task, self.weights).withColumnRenamed("test_id", "_probe")
        out = rows.join(votes, "_probe", "left").drop("_probe")
        out = out.withColumn("prediction", F.col("prediction").cast("double"))
        if self.task == "regression":
            return out.drop("votes")
        total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v["w"])
        share = lambda i: F.aggregate(F.filter("votes", lambda v: v["label"] == i), F.lit(0.0), lambda a, v: a + v["w"]) / total
        shares = F.transform(F.sequence(F.lit(0), F.lit(self.classes - 1)), share)
        return out.withColumn("probability", array_to_vector(shares)).drop("votes")

    def write(self) -> _Writer:
        return _Writer(self)

    @staticmethod
    def load(path: str) -> NeighboursModel:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/settings").first()[0])
        return NeighboursModel(Index.load(spark, f"{path}/index"), **meta)


@dataclass
class _Writer:
    model: NeighboursModel

    def save(self, path: str) -> None:
        m = self.model
        m.index.save(f"{path}/index")
        meta = {"n_neighbors": m.n_neighbors, "weights": m.weights, "task": m.task, "classes": m.classes}
        spark = m.index.rows.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "settings string").coalesce(1).write.text(f"{path}/settings")


def _voted_all(found: DataFrame, candidates: Sequence[Mapping], task: str) -> DataFrame:
    """(test_id, p0, p1, ...): what :func:`voted` predicts under every setting, from one pass over the neighbours."""
    # where the nearest is an exact match it is one for any number of neighbours
    rows = found.withColumn("hit", F.min("distance").over(Window.partitionBy("test_id")) == 0)
    exact = F.when(F.col("hit"), (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    weights = {}
    for i, c in enumerate(candidates):
        weight = exact if c.get("weights", "uniform") == "distance" else F.lit(1.0)
        weights[f"w{i}"] = F.when(F.col("place") <= int(c.get("n_neighbors", NEIGHBOURS)), weight)
    rows = rows.select("test_id", "label", *[w.alias(n) for n, w in weights.items()])
    if task == "regression":
        return rows.groupBy("test_id").agg(*[(F.sum(F.col(w) * F.col("label")) / F.sum(w)).alias(f"p{i}") for i, w in enumerate(weights)])
    votes = rows.groupBy("test_id", "label").agg(*[F.sum(w).alias(w) for w in weights])
    best = lambda w: F.min(F.when(F.col(w).isNotNull(), F.struct((-F.col(w)).alias("w"), F.col("label"))))["label"]
    return votes.groupBy("test_id").agg(*[best(w).alias(f"p{i}") for i, w in enumerate(weights)])


def neighbour_scores(train: DataFrame, candidates: Sequence[Mapping], task: str, classes: int) -> list[float]:
    """Mean over the folds of accuracy or R2 of every setting: one search for the most neighbours per fold serves all.

    Equal points have equal neighbours and are searched once. Of the equal training points of a fold only those stored first can
    be among the nearest, as many as there are neighbours; the others are left out of the index.
    """
    most = max(int(c.get("n_neighbors", NEIGHBOURS)) for c in candidates)
    columns = ["fold", F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("point"), F.col("label").cast("double").alias("label")]
    rows = durable(train.select(*columns))  # the ids have to stay
    stored = Window.partitionBy("fold", "point").orderBy("id")
    kept = durable(rows.withColumn("_place", F.row_number().over(stored)).where(F.col("_place") <= most).drop("_place"))
    asked = rows.groupBy("fold", "point", "label").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = durable(asked.withColumn("probe", F.min("id").over(Window.partitionBy("fold", "point"))))
    totals = [0.0] * len(candidates)
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    y, n = F.col("truth"), F.col("n")
    for f in folds:
        mine = asked.where(F.col("fold") == f)
        index = Index.build(kept.where(F.col("fold") != f), keep=True)
        found = index.nearest(mine.where(F.col("id") == F.col("probe")).select("id", "point"), most)
        truth = mine.select(F.col("probe").alias("test_id"), F.col("label").alias("truth"), "n")
        answers = truth.join(_voted_all(found, candidates, task), "test_id")
        mean = lambda value: F.sum(n * value) / F.sum(F.when(value.isNotNull(), n))
        guesses = [F.col(f"p{i}").cast("double") for i in range(len(candidates))]
        if task == "classification":
            scores = [mean((y == p).cast("double")) for p in guesses]
        else:
            answers = durable(answers)
            spread = mean((y - F.lit(answers.agg(mean(y)).first()[0])) ** 2)
            scores = [1 - mean((y - p) * (y - p)) / spread for p in guesses]
        for i, score in enumerate(answers.agg(*[s.alias(f"s{i}") for i, s in enumerate(scores)]).first()):
            totals[i] += float(score)
    return [t / len(folds) for t in totals]
