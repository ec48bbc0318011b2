"""Clustering, measures of clusterings, and supervised time series."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, GaussianMixtureModel, KMeans, PowerIterationClustering
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators import evaluate
from tablewright.operators.blocks import block_sums, nearest
from tablewright.operators.learn import estimator
from tablewright.operators.prep import fit_preparation, split_temporal
from tablewright.operators.series import series_features
from tablewright.plans import wide
from tablewright.plans.durable import durable
from tablewright.plans.types import quoted

CLUSTER_LIMIT = 1000
# Cluster numbers tried
CLUSTER_NUMBERS = [2, 3, 4, 5, 6, 7, 8]
MODELS = {"kmeans": KMeans, "hierarchical": BisectingKMeans}
# MLlib's settings of a mixture
_MIXTURE_STEPS, _MIXTURE_TOLERANCE, _EPSILON = 100, 0.01, float(np.finfo("float64").eps)
#: Rows of a matrix product.
_MIXTURE_ROWS = 2000


@dataclass
class Mixture:
    """Weights, means and covariances of Gaussian components, and the last two log likelihoods."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float = -np.finfo("float64").max
    previous: float = 0.0

    def scaled(self) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
        """(weight, mean, root of the pseudo-inverse of the covariance, log of the factor) of every component, as MLlib takes them."""
        out = []
        for w, mean, covariance in zip(self.weights, self.means, self.covariances):
            if not np.isfinite(covariance).all():
                raise np.linalg.LinAlgError("not finite")
            values, vectors = np.linalg.eigh(covariance)
            real = values > _EPSILON * values.max() * len(values)
            if not real.any():
                raise np.linalg.LinAlgError("covariance without non-zero singular values")
            root = vectors[:, real] / np.sqrt(values[real])
            out.append((w, mean, root, -0.5 * (len(values) * np.log(2 * np.pi) + np.log(values[real]).sum())))
        return out


def _expected(x: np.ndarray, scaled: list) -> list[np.ndarray]:
    """Log likelihood, and weights, weighted sums and weighted products by component, of some rows."""
    k, width = len(scaled), x.shape[1]
    p, products = np.empty((len(x), k)), np.empty((k, width, width))
    for c, (w, mean, root, factor) in enumerate(scaled):
        z = (x - mean) @ root
        p[:, c] = _EPSILON + w * np.exp(factor - 0.5 * np.einsum("ij,ij->i", z, z))
    total = p.sum(axis=1)
    p /= total[:, None]
    for c in range(k):
        products[c] = (x * p[:, c : c + 1]).T @ x
    return [np.array([np.log(total).sum()]), p.sum(axis=0), p.T @ x, products]


def _added(a: dict, b: dict) -> dict:
    return {k: [x + y for x, y in zip(a[k], b[k])] for k in a}


def fit_mixtures(vectors: DataFrame, numbers: Sequence[int], seed: int = 42) -> dict[int, GaussianMixtureModel | None]:
    """MLlib's Gaussian mixtures of (features) for several numbers of components, fitted together; None where the points do not determine them.

    MLlib draws the starting components. Its steps of expectation and maximisation, its tolerance and its limit of steps are kept; a step is one
    scan for all numbers, with matrix products over blocks of rows, of which only sums by component reach the driver.
    """
    found: dict[int, GaussianMixtureModel | None] = dict.fromkeys(numbers)
    open_: dict[int, Mixture] = {}
    for k in numbers:
        try:
            start = GaussianMixture(k=k, seed=seed, maxIter=0).fit(vectors)
        except Py4JJavaError:
            continue
        parts = [(g.mean.toArray(), g.cov.toArray()) for g in start.gaussiansDF.collect()]  # k rows
        open_[k] = Mixture(np.array(start.weights), np.array([m for m, _ in parts]), np.array([c for _, c in parts]))
    if not open_:
        return found
    width = next(iter(open_.values())).means.shape[1]

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)
                parts = [rows[at : at + _MIXTURE_ROWS].tobytes() for at in range(0, len(rows), _MIXTURE_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, type=pa.binary())], names=["rows"])

    sc = vectors.sparkSession.sparkContext
    blocks = vectors.select(vector_to_array("features").alias("x")).mapInArrow(packed, "rows binary")
    blocks = blocks.repartition(2 * sc.defaultParallelism)  # a file may be a single task
    blocks = blocks.rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    done: dict[int, Mixture] = {}
    for _ in range(_MIXTURE_STEPS):
        scaled = {}
        for k, m in list(open_.items()):
            try:
                if abs(m.likelihood - m.previous) > _MIXTURE_TOLERANCE:
                    scaled[k] = m.scaled()
                else:
                    done[k] = open_.pop(k)
            except np.linalg.LinAlgError:
                del open_[k]
        if not open_:
            break
        sent = sc.broadcast(scaled)
        sums = blocks.map(lambda b: {k: _expected(np.frombuffer(b).reshape(-1, width), s) for k, s in sent.value.items()}).treeReduce(_added)  # noqa: B023
        sent.destroy()
        for k, (likelihood, weights, means, products) in sums.items():
            means = means / weights[:, None]
            covariances = products / weights[:, None, None] - means[:, :, None] * means[:, None, :]
            open_[k] = Mixture(weights / weights.sum(), means, covariances, float(likelihood[0]), open_[k].likelihood)
    blocks.unpersist()
    for k, m in {**done, **open_}.items():
        try:
            m.scaled()
            found[k] = _mixture_model(sc, m)
        except (np.linalg.LinAlgError, Py4JJavaError):
            pass
    return found


def _mixture_model(sc, m: Mixture) -> GaussianMixtureModel:
    jvm, gateway = sc._jvm, sc._gateway
    normal = jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian
    weights, normals = gateway.new_array(jvm.double, len(m.weights)), gateway.new_array(normal, len(m.weights))
    for i, (w, mean, c) in enumerate(zip(m.weights, m.means, m.covariances)):
        weights[i] = float(w)
        normals[i] = normal(_py2java(sc, DenseVector(mean)), _py2java(sc, DenseMatrix(*c.shape, c.ravel(order="F").tolist())))
    made = jvm.org.apache.spark.ml.clustering.GaussianMixtureModel(f"GaussianMixture_{uuid.uuid4().hex[:12]}", weights, normals)
    return GaussianMixtureModel(made)


def fit_best(df: DataFrame, kind: str, numbers: Sequence[int] = CLUSTER_NUMBERS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Cluster (id, point) with every number of clusters and keep the best silhouette (of squared distances).

    Returns the assignment (id, cluster) and the score of every number tried.  A number that leaves fewer than
    two clusters, or components that the points do not determine, has no score.
    """
    vectors = df.select("id", array_to_vector("point").alias("features")).persist()
    judge = ClusteringEvaluator()
    best, rows = None, []
    mixtures = fit_mixtures(vectors, numbers, seed) if kind == "gmm" else {}
    for k in numbers:
        model = mixtures[k] if kind == "gmm" else MODELS[kind](k=k, seed=seed).fit(vectors)
        if model is None:  # a mixture with more components than the points can tell apart
            rows.append((k, None))
            continue
        found = model.transform(vectors)
        if found.select("prediction").distinct().count() < 2:
            rows.append((k, None))
            continue
        score = float(judge.evaluate(found))
        rows.append((k, score))
        if best is None or score > best[0]:
            best = (score, found)
    if best is None:
        raise ValueError("no number of clusters gave two clusters")
    assigned = durable(best[1].select("id", F.col("prediction").alias("cluster")))
    vectors.unpersist()
    return assigned, wide.rows_frame(df.sparkSession, rows, "k int, silhouette_squared double")


def spectral(df: DataFrame, k: int, neighbours: int = 10) -> DataFrame:
    """Power iteration clustering of the nearest-neighbour graph of (id, point), closer rows weighing more."""
    labelled = df.select("id", "point", F.lit(0).alias("label"))
    edges = nearest(labelled, labelled, neighbours, same=True)
    pairs = edges.select(
        F.least("test_id", "train_id").alias("src"), F.greatest("test_id", "train_id").alias("dst"), (1 / (1 + F.col("distance"))).alias("weight")
    ).distinct()
    found = PowerIterationClustering(k=k, maxIter=20, initMode="degree", weightCol="weight").assignClusters(pairs)
    return found.select("id", "cluster")


# --- measures ---------------------------------------------------------------------------------------


def _squared(point: Column, centre: Column) -> Column:
    gaps = F.zip_with(point, centre, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, v: total + v)


def _centres(df: DataFrame) -> dict:
    """Size and centre per cluster; bounded by the number of clusters."""
    stats = df.groupBy("cluster").agg(Summarizer.mean(array_to_vector("point")).alias("m"), F.count("*").alias("n"))
    rows = stats.limit(CLUSTER_LIMIT + 1).collect()
    if len(rows) > CLUSTER_LIMIT:
        raise ValueError(f"more than {CLUSTER_LIMIT} clusters")
    return {r["cluster"]: (int(r["n"]), r["m"].toArray()) for r in rows}


def _own_centre(centres: dict) -> Column:
    out = F.lit(None).cast("array<double>")
    for c, (_, m) in centres.items():
        out = F.when(F.col("cluster") == F.lit(c), F.array(*[F.lit(float(v)) for v in m])).otherwise(out)
    return out


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """Dispersion between clusters over dispersion within, of (point, cluster)."""
    centres = _centres(df)
    n, k = sum(c[0] for c in centres.values()), len(centres)
    whole = sum(size * m for size, m in centres.values()) / n
    between = sum(size * float(((m - whole) ** 2).sum()) for size, m in centres.values())
    within = F.sum(_squared(F.col("point"), _own_centre(centres)))
    return df.agg((F.lit(between) / within * ((n - k) / (k - 1))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to centre distance, of (point, cluster)."""
    centres = _centres(df)
    spread = df.groupBy("cluster").agg(F.avg(F.sqrt(_squared(F.col("point"), _own_centre(centres)))).alias("s"))
    found = {r["cluster"]: r["s"] for r in spread.collect()}
    worst = [
        max((found[a] + found[b]) / float(np.linalg.norm(centres[a][1] - centres[b][1])) for b in centres if b != a) for a in centres
    ]
    return wide.rows_frame(df.sparkSession, [(float(np.mean(worst)),)], "davies_bouldin double")


def cluster_counts(df: DataFrame, noise: int = -1) -> DataFrame:
    """Number of clusters without noise, and of noise rows."""
    sizes = df.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count_if(F.col("cluster") != noise).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") == noise, F.col("n"))), F.lit(0)).alias("n_noise"),
    )


def silhouette_squared(df: DataFrame) -> float:
    """Mean silhouette under squared Euclidean distance of (point, cluster): linear in the rows."""
    vectors = df.select(array_to_vector("point").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    return float(ClusteringEvaluator().evaluate(vectors))


def silhouette_rows(df: DataFrame) -> DataFrame:
    """Exact Euclidean silhouette of every row of (id, point, cluster).  Quadratic work in bounded blocks."""
    labels = sorted(_centres(df))

    kind = df.schema["id"].dataType.simpleString()
    parts = block_sums(df.select("id", "point", F.col("cluster").alias("group")), labels, f"id {kind}, sums array<double>")
    summed = parts.groupBy("id").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(labels))])
    sizes = {r["cluster"]: r["n"] for r in df.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    joined = df.select("id", "cluster").join(summed, "id")
    own, size, other = F.lit(None).cast("double"), F.lit(None).cast("bigint"), []
    for i, c in enumerate(labels):
        mine = F.col("cluster") == F.lit(c)
        own = F.when(mine, F.col(f"s{i}")).otherwise(own)
        size = F.when(mine, F.lit(sizes[c])).otherwise(size)
        other.append(F.when(~mine, F.col(f"s{i}") / F.lit(sizes[c])))
    a = F.try_divide(own, size - 1)
    b = F.array_min(F.array(*other))
    value = F.when(size > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return joined.select("id", "cluster", a.alias("a"), b.alias("b")).select("id", "cluster", value.alias("silhouette"))


# --- time series ------------------------------------------------------------------------------------


def supervised_series(
    df: DataFrame, target: str, order_by: Sequence[str], model: str = "Linear", params: dict | None = None, exclude_current: bool = False
) -> DataFrame:
    """Lag and rolling features, the last fifth as test, a model on the standardised rest; metrics in one row.

    The rolling windows hold the value to be predicted unless ``exclude_current``.
    """
    total = df.count()
    if total < 20:
        raise ValueError("a series needs at least 20 rows")
    made = series_features(df.select(*order_by, quoted(target)), target, order_by, exclude_current=exclude_current, rows=total)
    made = durable(made)  # the split, the preparation, the fit and the metrics all read it
    split = split_temporal(made, order_by)
    names = [c for c in made.columns if c not in order_by and c != target]
    train = split.where(~F.col("is_test"))
    prep = fit_preparation(train, names)
    def side(frame: DataFrame) -> DataFrame:
        coded = frame.withColumn("_label", quoted(target).cast("double"))
        return prep.vectors(coded, ["_label"]).withColumnRenamed("_label", "label")

    fit_rows = side(train).persist()
    n, std = fit_rows.agg(F.count("*"), F.stddev_pop("label")).first()
    fitted = estimator(model, "regression", n, params=params, label_std=std).fit(fit_rows)
    fit_rows.unpersist()
    return evaluate.regression_metrics(fitted.transform(side(split.where("is_test"))), "label", "prediction")
