"""Training, search and comparison of MLlib models, and scoring of whole tables."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.operators import evaluate
from tablewright.operators.blocks import nearest
from tablewright.operators.boosting import SoftmaxBoosting
from tablewright.operators.models import (
    NEIGHBOURS, SMOOTHING, GaussianBayes, NearestNeighbours, bayes_scores, neighbour_scores, voted,
)
from tablewright.operators.detection import require_valid_target, suggest_target, task_type
from tablewright.operators.prep import (
    TEST_SHARE, Preparation, assign_folds, can_stratify, class_sizes, fit_preparation, hash_position, split_random,
    split_stratified, training_sizes,
)
from tablewright.plans import wide
from tablewright.plans.grouped import group_sizes
from tablewright.plans.ordered import row_numbers
from tablewright.plans.selection import first_rows_bound
from tablewright.plans.types import known, quoted

SEED = 42
TOLERANCE = 1e-4  # the usual stopping rule of linear classifiers
COLLINEAR = 1e-9  # enough to solve plain least squares when one-hot columns add up to one
SPARK_DEPTH = 30  # the deepest tree Spark grows; stands for "no limit"

# The parameter grids
GRIDS = {
    "LogisticRegression": {"C": [0.01, 0.1, 1, 10]},
    "RandomForest": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20]},
    "GradientBoosting": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1], "max_depth": [3, 5]},
    "DecisionTree": {"max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10]},
    "LinearSVM": {"C": [0.1, 1, 10]},
    "KNN": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "NaiveBayes": {"var_smoothing": [1e-09, 1e-08, 1e-07]},
    "Ridge": {"alpha": [0.01, 0.1, 1, 10, 100]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1]},
    "Linear": {},
}
CLASSIFIERS = ["LogisticRegression", "RandomForest", "GradientBoosting", "DecisionTree", "LinearSVM", "KNN", "NaiveBayes"]
REGRESSORS = ["Linear", "Ridge", "Lasso", "RandomForest", "GradientBoosting", "DecisionTree", "KNN"]
# The ranges of a search without a grid
RANGES = {
    "LogisticRegression": {"C": {"low": 0.001, "high": 100, "log": True}},
    "RandomForest": {
        "n_estimators": {"low": 10, "high": 300, "step": 1},
        "max_depth": {"low": 2, "high": 50, "step": 1},
        "min_samples_split": {"low": 2, "high": 20, "step": 1},
        "min_samples_leaf": {"low": 1, "high": 10, "step": 1},
    },
    "GradientBoosting": {
        "n_estimators": {"low": 10, "high": 300, "step": 1},
        "learning_rate": {"low": 0.001, "high": 0.5, "log": True},
        "max_depth": {"low": 2, "high": 10, "step": 1},
        "subsample": {"low": 0.5, "high": 1.0},
    },
    "DecisionTree": {
        "max_depth": {"low": 2, "high": 30, "step": 1},
        "min_samples_split": {"low": 2, "high": 20, "step": 1},
        "min_samples_leaf": {"low": 1, "high": 10, "step": 1},
    },
    "LinearSVM": {"C": {"low": 0.001, "high": 100, "log": True}},
    "KNN": {"n_neighbors": {"low": 1, "high": 30, "step": 1}, "weights": {"values": ["uniform", "distance"]}},
    "NaiveBayes": {"var_smoothing": {"low": 1e-12, "high": 1e-6, "log": True}},
    "Ridge": {"alpha": {"low": 0.001, "high": 100, "log": True}},
    "Lasso": {"alpha": {"low": 0.0001, "high": 10, "log": True}},
}
# Parameter swept by a validation curve
SWEEPS = {
    "n_estimators": [10, 25, 50, 75, 100, 150, 200],
    "C": [0.01, 0.1, 1, 10, 100],
    "max_depth": [2, 3, 5, 7, 10, 15],
    "n_neighbors": [3, 5, 7, 9, 11, 15, 21],
}


def estimator(
    name: str, task: str, rows: int, classes: int = 2, params: Mapping[str, object] | None = None, label_std: float = 1.0
) -> Estimator:
    """An MLlib estimator with the penalties of the usual per-row objectives (C, alpha) turned into ``regParam``.

    Spark fits linear models to the label divided by its deviation, which weakens a squared penalty by that
    deviation; ``label_std`` makes up for it.
    """
    p = dict(params or {})
    depth = lambda default: SPARK_DEPTH if p.get("max_depth", default) is None else int(p.get("max_depth", default))
    # a split needs min_samples_split rows, so a leaf of an even split holds half of them
    leaf = max(1, int(p.get("min_samples_leaf", p.get("min_samples_split", 2) // 2)))
    c_penalty = 1.0 / (float(p.get("C", 1.0)) * rows)
    classify = task == "classification"
    if name == "LogisticRegression":
        return LogisticRegression(regParam=c_penalty, standardization=False, maxIter=100, tol=TOLERANCE)
    if name == "LinearSVM":
        svm = LinearSVC(regParam=c_penalty, standardization=False, maxIter=50, tol=TOLERANCE)
        return svm if classes == 2 else OneVsRest(classifier=svm, parallelism=4)
    if name == "NaiveBayes":
        return GaussianBayes(float(p.get("var_smoothing", SMOOTHING)), classes)
    if name == "KNN":
        return NearestNeighbours(int(p.get("n_neighbors", NEIGHBOURS)), str(p.get("weights", "uniform")), task, classes)
    if name == "RandomForest":
        kind = RandomForestClassifier if classify else RandomForestRegressor
        return kind(numTrees=int(p.get("n_estimators", 100)), maxDepth=depth(None), minInstancesPerNode=leaf, seed=SEED)
    if name == "DecisionTree":
        kind = DecisionTreeClassifier if classify else DecisionTreeRegressor
        return kind(maxDepth=depth(None), minInstancesPerNode=leaf, seed=SEED)
    if name == "GradientBoosting" and classify and classes > 2:
        return SoftmaxBoosting(
            p.get("n_estimators", 100), p.get("learning_rate", 0.1), depth(3), p.get("subsample", 1.0), leaf, classes, SEED
        )
    if name == "GradientBoosting":
        kind = GBTClassifier if classify else GBTRegressor
        gbt = kind(
            maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)), maxDepth=depth(3),
            subsamplingRate=float(p.get("subsample", 1.0)), minInstancesPerNode=leaf, seed=SEED,
        )
        return gbt
    if name in ("Linear", "Ridge", "Lasso"):
        alpha = float(p.get("alpha", 1.0))
        penalty = {"Linear": COLLINEAR, "Ridge": alpha * label_std / rows, "Lasso": alpha}[name]
        lasso = name == "Lasso"
        return LinearRegression(regParam=penalty, elasticNetParam=1.0 if lasso else 0.0, standardization=False, tol=1e-9 if lasso else 1e-6)
    raise ValueError(f"unknown model {name!r}")


# --- data -------------------------------------------------------------------------------------------


@dataclass
class TrainingData:
    """Prepared rows: keys, ``label`` (code or value), ``features`` and, for training rows, ``fold``."""

    task: str
    target: str
    keys: list[str]
    train: DataFrame
    test: DataFrame
    preparation: Preparation
    classes: list
    train_rows: int
    label_std: float = 1.0
    source: DataFrame | None = None

    def release(self) -> None:
        """Give back the cached rows."""
        self.train.unpersist()
        if self.source is not None:
            self.source.unpersist()

    @property
    def names(self) -> list[str]:
        return self.preparation.feature_names


def label_column(df: DataFrame, target: str, classes: Sequence):
    """Code of a class as double; the value itself when there are no classes."""
    if not classes:
        return known(df, target).cast("double")
    place = F.array_position(F.array(*[F.lit(v) for v in classes]), quoted(target))
    return F.when(place > 0, (place - 1).cast("double"))


def prepare(
    df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str] | None = None, task: str | None = None, folds: int = 3
) -> TrainingData:
    """Split first, learn the preparation from the training rows only, then prepare both sides."""
    features = list(features or [c for c in df.columns if c != target and c not in keys])
    # the split, the preparation and both sides read these columns again and again
    needed = spread(df.select(*[quoted(c) for c in dict.fromkeys([*keys, *features, target])])).persist()
    task = task or task_type(needed, target)
    require_valid_target(needed, target, task)
    rows = needed.where(known(needed, target).isNotNull())
    if task == "classification":
        table = group_sizes(rows, target)
        sizes = class_sizes(rows, target, table)
        classes, total = list(sizes), sum(sizes.values())
        split = split_stratified(rows, keys, target, sizes=table)
        left = training_sizes(table) if can_stratify(table, TEST_SHARE) else None
        dealt = assign_folds(split.where(~F.col("is_test")), keys, folds, target, SEED + 1, left)
    else:
        classes, total = [], rows.count()
        split = split_random(rows, keys)
        dealt = assign_folds(split.where(~F.col("is_test")), keys, folds, seed=SEED + 1)
    fitted = fit_preparation(split.where(~F.col("is_test")), features, rows=total)
    label = label_column(rows, target, classes)

    def side(frame: DataFrame, *extra: str) -> DataFrame:
        coded = frame.withColumn("_label", label)  # the target itself may be called label
        return fitted.vectors(coded, [*keys, "_label", *extra]).withColumnRenamed("_label", "label")

    train = side(dealt, "fold").persist()  # read by every fit and fold
    test = side(split.where("is_test"))
    n, std = train.agg(F.count("*"), F.stddev_pop("label")).first()
    return TrainingData(task, target, list(keys), train, test, fitted, classes, n, std if task == "regression" else 1.0, needed)


ROWS_PER_TASK = 20_000
#: Rows of a piece that a fit walks; beyond, there are more pieces than cores.
MOST_ROWS_PER_TASK = 250_000


def spread(df: DataFrame) -> DataFrame:
    """Rows that every fit walks again and again, dealt over the cores where the source has too few pieces for its size.

    The rows of the pieces count, not their number: a file may be cut where it has no row group, which leaves pieces empty.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("piece")).agg(F.count("*").alias("n")).collect()]
    rows = sum(sizes)
    wanted = max(min(cores, math.ceil(rows / ROWS_PER_TASK)), math.ceil(rows / MOST_ROWS_PER_TASK))
    return df.repartition(wanted) if wanted > len(sizes) or max(sizes, default=0) > 2 * max(rows / max(wanted, 1), ROWS_PER_TASK) else df


# --- scores -----------------------------------------------------------------------------------------


def metrics(predictions: DataFrame, task: str) -> dict[str, float]:
    """Measures of predictions; where the model gives probabilities also log loss and ROC area.

    The area is that of class 1 of two, else the mean of all classes weighted by their rows; without rows of every class there is none.
    """
    if task == "classification":
        found = evaluate.classification_metrics(predictions, "label", "prediction").first().asDict()
        return found | (_probability_metrics(predictions) if "probability" in predictions.columns else {})
    return evaluate.regression_metrics(predictions, "label", "prediction").first().asDict()


def _probability_metrics(predictions: DataFrame) -> dict[str, float | None]:
    rows = predictions.select(F.col("label").cast("int").alias("label"), vector_to_array("probability").alias("shares"))
    own = F.least(F.greatest(F.col("shares")[F.col("label")], F.lit(evaluate.EPSILON)), F.lit(1 - evaluate.EPSILON))
    loss, classes, found = rows.agg(-F.avg(F.ln(own)), F.max(F.size("shares")), F.count_distinct("label")).first()
    if found != classes or classes < 2:
        return {"log_loss": loss, "roc_auc": None}
    judged = [1] if classes == 2 else range(classes)
    wide_rows = rows.select("label", *[F.col("shares")[i].alias(f"p{i}") for i in judged])
    per_label = evaluate.roc_auc(wide_rows, "label", {i: f"p{i}" for i in judged})
    return {"log_loss": loss, "roc_auc": evaluate.average_auc(per_label).first()["weighted_auc"]}


def main_metric(task: str) -> str:
    return {"classification": "accuracy", "regression": "r2", "clustering": "silhouette"}[task]


def _score(model: Transformer, df: DataFrame, task: str) -> float:
    """Accuracy or R2 alone: one scan."""
    y, p = F.col("label"), F.col("prediction")
    score = F.avg((y == p).cast("double")) if task == "classification" else 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)
    return float(model.transform(df).agg(score).first()[0])


def _new(data: TrainingData, name: str, params: Mapping | None) -> Estimator:
    return estimator(name, data.task, data.train_rows, max(2, len(data.classes)), params, data.label_std)


def fold_scores(data: TrainingData, name: str, params: Mapping | None = None) -> list[float]:
    """Validation score of every fold."""
    folds = sorted(r["fold"] for r in data.train.select("fold").distinct().collect())
    out = []
    for f in folds:
        model = _new(data, name, params).fit(data.train.where(F.col("fold") != f))
        out.append(_score(model, data.train.where(F.col("fold") == f), data.task))
    return out


def fit(data: TrainingData, name: str, params: Mapping | None = None) -> Transformer:
    return _new(data, name, params).fit(data.train)


def predictions(data: TrainingData, model: Transformer) -> DataFrame:
    """Keys, label and prediction of the test rows."""
    return model.transform(data.test).select(*data.keys, "label", "prediction")


# --- search -----------------------------------------------------------------------------------------


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def random_combinations(grid: Mapping[str, Sequence], n: int, seed: int = SEED) -> list[dict]:
    """A seeded sample of the grid without repeats."""
    every = combinations(grid)
    return every if n >= len(every) else random.Random(seed).sample(every, n)


@dataclass
class Found:
    name: str
    params: dict
    score: float
    model: Transformer
    tried: list[tuple[dict, float]] = field(default_factory=list)


def search(data: TrainingData, name: str, candidates: Sequence[Mapping], parallelism: int = 4) -> Found:
    """Cross-validate the candidates on the prepared folds and refit the best on all training rows.

    Bayes and neighbours score all candidates of a fold from shared work.
    """
    if name in ("NaiveBayes", "KNN"):
        classes = max(2, len(data.classes))
        if name == "NaiveBayes":
            scores = bayes_scores(data.train, [float(c.get("var_smoothing", SMOOTHING)) for c in candidates], classes)
        else:
            scores = neighbour_scores(data.train, candidates, data.task, classes)
        best = max(range(len(scores)), key=lambda i: scores[i])
        return Found(name, dict(candidates[best]), scores[best], fit(data, name, candidates[best]), list(zip(map(dict, candidates), scores)))
    base = _new(data, name, candidates[0])
    if isinstance(base, SoftmaxBoosting):
        scores = [sum(s) / len(s) for s in (fold_scores(data, name, c) for c in candidates)]
        best = max(range(len(scores)), key=lambda i: scores[i])
        return Found(name, dict(candidates[best]), scores[best], fit(data, name, candidates[best]), list(zip(map(dict, candidates), scores)))
    if data.task == "classification":
        judge = MulticlassClassificationEvaluator(metricName="accuracy")
    else:
        judge = RegressionEvaluator(metricName="r2")
    maps = []
    for params in candidates:
        made = _new(data, name, params)
        source = made.getClassifier() if isinstance(made, OneVsRest) else made
        target = base.getClassifier() if isinstance(base, OneVsRest) else base
        maps.append({target.getParam(p.name): v for p, v in source.extractParamMap().items() if source.isSet(p)})
    folds = data.train.select("fold").distinct().count()
    validator = CrossValidator(
        estimator=base, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallelism
    )
    result = validator.fit(data.train)
    scores = [float(s) for s in result.avgMetrics]
    best = max(range(len(scores)), key=lambda i: scores[i])
    return Found(name, dict(candidates[best]), scores[best], result.bestModel, list(zip(map(dict, candidates), scores)))


def grid_search(data: TrainingData, name: str, grid: Mapping[str, Sequence] | None = None) -> Found:
    return search(data, name, combinations(GRIDS[name] if grid is None else grid))


def random_search(data: TrainingData, name: str, n: int = 5, grid: Mapping[str, Sequence] | None = None) -> Found:
    return search(data, name, random_combinations(GRIDS[name] if grid is None else grid, n))


def draws(ranges: Mapping[str, Mapping], n: int, seed: int = SEED) -> list[dict]:
    """``n`` seeded draws: evenly from listed values, whole steps and intervals, by their logarithm where ``log`` is set."""
    pick = random.Random(seed)

    def one(r: Mapping):
        if "values" in r:
            return pick.choice(list(r["values"]))
        low, high = r["low"], r["high"]
        if r.get("log"):
            return min(high, max(low, math.exp(pick.uniform(math.log(low), math.log(high)))))
        if "step" in r:
            return low + r["step"] * pick.randrange(int((high - low) // r["step"]) + 1)
        return pick.uniform(low, high)

    return [{k: one(r) for k, r in ranges.items()} for _ in range(n)]


def range_search(data: TrainingData, name: str, n: int = 10, ranges: Mapping[str, Mapping] | None = None, seed: int = SEED) -> Found:
    """Search ``n`` draws from the ranges of a model instead of the points of a grid."""
    return search(data, name, draws(RANGES[name] if ranges is None else ranges, n, seed))


def tried_frame(data: TrainingData, found: Found) -> DataFrame:
    rows = [(found.name, json.dumps(p), float(s), p == found.params) for p, s in found.tried]
    return wide.rows_frame(data.train.sparkSession, rows, "model string, params string, cv_score double, best boolean")


# --- several models ---------------------------------------------------------------------------------


def train_ranked(
    data: TrainingData, names: Sequence[str] | None = None, n: int | None = None, grids: Mapping[str, Mapping] | None = None
) -> tuple[DataFrame, dict[str, Found]]:
    """Search every algorithm, score it on the test rows and rank; a failing algorithm becomes an error row.

    The whole grid of an algorithm is tried, or ``n`` seeded draws from it.
    """
    names = list(names or (CLASSIFIERS if data.task == "classification" else REGRESSORS))
    rows, found = [], {}
    for name in names:
        start = time.time()
        try:
            grid = (grids or {}).get(name, GRIDS[name])
            best = grid_search(data, name, grid) if n is None else random_search(data, name, n, grid)
            scores = metrics(best.model.transform(data.test), data.task)
            found[name] = best
            rows.append((name, json.dumps(best.params), best.score, float(scores[main_metric(data.task)]), json.dumps(scores), time.time() - start, None))
        except Exception as error:  # one algorithm must not stop the others
            rows.append((name, None, None, None, None, time.time() - start, str(error)[:500]))
    frame = wide.rows_frame(
        data.train.sparkSession,
        rows,
        "model string, params string, cv_score double, test_score double, metrics string, seconds double, error string",
    )
    return leaderboard(frame, "test_score", "model"), found


def leaderboard(results: DataFrame, metric: str, key: str) -> DataFrame:
    """Results (one row per model) ranked by a metric, models without it last."""
    keyed = results.withColumns({"_none": quoted(metric).isNull(), "_down": -quoted(metric)})
    placed = row_numbers(keyed, ["_none", "_down", key], "place").drop("_none", "_down")
    return placed.withColumn("place", F.col("place").cast("int")).orderBy("place")


def baseline_and_optimized(data: TrainingData, name: str, baseline: Mapping, n: int = 8, grid: Mapping | None = None) -> DataFrame:
    """Metric rows before and after a search; the search result counts only if its CV score is not worse."""
    before_cv = sum(scores := fold_scores(data, name, baseline)) / len(scores)
    before = metrics(fit(data, name, baseline).transform(data.test), data.task)
    best = random_search(data, name, n, grid)
    kept = best.score >= before_cv
    after = metrics(best.model.transform(data.test), data.task) if kept else before
    rows = [("cv_score", before_cv, best.score if kept else before_cv, kept)]
    rows += [(k, before[k], after[k], kept) for k in before if before[k] is not None]
    frame = wide.rows_frame(data.train.sparkSession, rows, "metric string, baseline double, optimized double, improved boolean")
    return frame.withColumn("delta", F.round(F.col("optimized") - F.col("baseline"), 4))


def compare(data: TrainingData, models: Mapping[str, Transformer]) -> DataFrame:
    """All models on the same test rows; a model that fails is an error row."""
    test = data.test.persist()
    rows = []
    for name, model in models.items():
        try:
            scores = metrics(model.transform(test), data.task)
            rows += [(name, k, v, None) for k, v in scores.items()]
        except Exception as error:
            rows.append((name, None, None, str(error)[:500]))
    test.unpersist()
    return wide.rows_frame(data.train.sparkSession, rows, "model string, metric string, value double, error string")


def learning_curve(data: TrainingData, name: str, params: Mapping | None = None, sizes: int = 5) -> DataFrame:
    """Train and validation score (mean, deviation over folds) for growing, nested parts of the training folds."""
    folds = sorted(r["fold"] for r in data.train.select("fold").distinct().collect())
    place = hash_position(data.keys, SEED + 2) / float(2**52)
    spark, rows = data.train.sparkSession, []
    for i in range(sizes):
        share = 0.1 + 0.9 * i / (sizes - 1)
        for f in folds:
            part = data.train.where((F.col("fold") != f) & (place <= share)).persist()
            n = part.count()
            model = estimator(name, data.task, max(n, 1), max(2, len(data.classes)), params, data.label_std).fit(part)
            rows.append((i, n, _score(model, part, data.task), _score(model, data.train.where(F.col("fold") == f), data.task)))
            part.unpersist()
    return _curve(spark, rows, "size int, rows bigint, train double, validation double", "size", F.avg("rows").cast("bigint").alias("train_rows"))


def validation_curve(data: TrainingData, name: str, param: str, values: Sequence | None = None, params: Mapping | None = None) -> DataFrame:
    """Train and validation score (mean, deviation over folds) along one parameter."""
    folds = sorted(r["fold"] for r in data.train.select("fold").distinct().collect())
    rows = []
    for v in values or SWEEPS[param]:
        for f in folds:
            part = data.train.where(F.col("fold") != f)
            model = _new(data, name, {**(params or {}), param: v}).fit(part)
            rows.append((float(v), _score(model, part, data.task), _score(model, data.train.where(F.col("fold") == f), data.task)))
    return _curve(data.train.sparkSession, rows, f"{param} double, train double, validation double", param)


def _curve(spark, rows: list, schema: str, by: str, *extra) -> DataFrame:
    frame = wide.rows_frame(spark, rows, schema)
    stats = [f(c).alias(f"{c}_{n}") for c in ("train", "validation") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return frame.groupBy(by).agg(*extra, *stats).orderBy(by)


def evaluate_dataset(df: DataFrame, keys: Sequence[str], target: str | None = None, models: Mapping[str, Mapping] | None = None) -> tuple[DataFrame, TrainingData]:
    """Find target and task, prepare, fit four baselines and rank them by F1 (then accuracy) or R2."""
    features = df.drop(*keys)
    target = target or suggest_target(features)
    task = task_type(features, target, "evaluation")
    data = prepare(df, target, keys, task=task)
    # The baselines
    defaults = (
        {"LogisticRegression": {}, "RandomForest": {"n_estimators": 50, "max_depth": 10}, "GradientBoosting": {"n_estimators": 50}, "DecisionTree": {"max_depth": 10}}
        if task == "classification"
        else {"Linear": {}, "RandomForest": {"n_estimators": 50, "max_depth": 10}, "GradientBoosting": {"n_estimators": 50}, "DecisionTree": {"max_depth": 10}}
    )
    rows = []
    for name, params in (models or defaults).items():
        try:
            scores = metrics(fit(data, name, params).transform(data.test), task)
            order = (scores["f1"], scores["accuracy"]) if task == "classification" else (scores["r2"], 0.0)
            rows.append((name, target, task, float(order[0]), float(order[1]), json.dumps(scores), None))
        except Exception as error:
            rows.append((name, target, task, None, None, None, str(error)[:500]))
    frame = wide.rows_frame(df.sparkSession, rows, "model string, target string, task string, score double, second double, metrics string, error string")
    best = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc_nulls_last(), F.col("second").desc_nulls_last(), "model")
    return frame.withColumn("place", F.row_number().over(best)).drop("second"), data


# --- neighbours -------------------------------------------------------------------------------------


def predict_knn(train: DataFrame, test: DataFrame, k: int = 5, task: str = "classification", weights: str = "uniform") -> DataFrame:
    """Prediction of every test row from its exact ``k`` nearest train rows.

    ``train`` has (id, point, label), ``test`` (id, point).  Votes are equal or weighted by 1 / distance, where
    exact matches silence the others; ties go to the smaller label.
    """
    return voted(nearest(train, test, k), task, weights).drop("votes")


def oversample(df: DataFrame, target: str, key: str, features: Sequence[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """Bring every class up to the largest with rows between a row and one of its ``k`` nearest of the same class.

    Returns (source_id, copy, label, features...); copy 0 is the row itself.
    """
    rows = df.select(quoted(key).alias("id"), quoted(target).alias("label"), F.array(*[quoted(c).cast("double") for c in features]).alias("point"))
    sizes = class_sizes(rows, "label")
    largest = max(sizes.values())
    named = lambda point: [F.element_at(point, i + 1).alias(c) for i, c in enumerate(features)]
    out = rows.select(F.col("id").alias("source_id"), F.lit(0).cast("bigint").alias("copy"), "label", *named(F.col("point")))
    for label, n in sorted(sizes.items(), key=str):
        need = largest - n
        if not need or n < 2:
            continue
        mine = rows.where(F.col("label") == F.lit(label))
        near = nearest(mine, mine, min(k, n - 1), same=True).select(F.col("test_id").alias("id"), "train_id", "place")
        # every row is copied need // n times, the first by hash once more
        copies = math.ceil(need / n)
        drawn = mine.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("copy", F.col("copy").cast("bigint"))
        draw = lambda what: F.pmod(F.xxhash64(F.lit(f"{seed}{what}"), "id", "copy"), F.lit(1_000_000))
        last = need - (copies - 1) * n
        if last < n:
            keep = first_rows_bound(mine, [hash_position(["id"], seed), F.col("id")], last)
            drawn = drawn.where((F.col("copy") < copies) | keep)
        drawn = drawn.withColumn("place", (F.pmod(draw("neighbour"), F.lit(min(k, n - 1))) + 1).cast("int"))
        other = mine.select(F.col("id").alias("train_id"), F.col("point").alias("other"))
        paired = drawn.join(near, ["id", "place"]).join(other, "train_id")
        step = draw("step") / 1_000_000.0
        between = F.zip_with("point", "other", lambda a, b: a + (b - a) * F.col("step"))
        made = paired.withColumn("step", step).withColumn("point", between)
        out = out.unionByName(made.select(F.col("id").alias("source_id"), "copy", "label", *named(F.col("point"))))
    return out


# --- saving and scoring -----------------------------------------------------------------------------


def save(path: str, model: Transformer, data: TrainingData, extra: Mapping[str, object] | None = None) -> None:
    """The fitted model, a one-row table of what is needed to use it, and the dictionary of columns with many categories."""
    model.write().save(f"{path}/model")
    p = data.preparation
    meta = {
        "kind": f"{type(model).__module__}.{type(model).__name__}",
        "task": data.task,
        "target": data.target,
        "classes": data.classes,
        "numeric": {c: list(v) for c, v in p.numeric.items()},
        "categorical": {c: [f, v] for c, (f, v) in p.categorical.items()},
        "dates": sorted(p.dates),
        "encoding": p.encoding,
        "sizes": p.sizes,
        **(extra or {}),
    }
    if p.dictionary is not None:
        p.dictionary.write.parquet(f"{path}/dictionary")
    frame = data.train.sparkSession.createDataFrame([(json.dumps(meta, default=str),)], "metadata string")
    frame.coalesce(1).write.json(f"{path}/metadata")


def load(spark, path: str) -> tuple[Transformer, Preparation, dict]:
    from importlib import import_module

    meta = json.loads(spark.read.schema("metadata string").json(f"{path}/metadata").first()[0])
    module, name = meta["kind"].rsplit(".", 1)
    if not module.startswith("pyspark.ml.") and module not in ("tablewright.operators.models", "tablewright.operators.boosting"):
        raise ValueError(f"not a model of MLlib or of this package: {meta['kind']}")
    model = getattr(import_module(module), name).load(f"{path}/model")
    prep = Preparation(
        {c: tuple(v) for c, v in meta["numeric"].items()},
        {c: (f, v) for c, (f, v) in meta["categorical"].items()},
        set(meta["dates"]),
        meta["encoding"],
        meta["sizes"],
        spark.read.parquet(f"{path}/dictionary") if meta["sizes"] else None,
    )
    return model, prep, meta


def batch_score(df: DataFrame, keys: Sequence[str], model: Transformer, prep: Preparation, classes: Sequence) -> DataFrame:
    """Prediction (as a label), confidence and the probabilities of the classes in order; missing features are 0, extra columns ignored."""
    needed = [*prep.numeric, *prep.categorical]
    absent = [c for c in needed if c not in df.columns]
    rows = df.withColumns({c: F.lit(0.0) if c in prep.numeric else F.lit("0") for c in absent}) if absent else df
    scored = model.transform(prep.vectors(rows, keys))
    prediction = F.col("prediction")
    if classes:
        prediction = F.element_at(F.array(*[F.lit(str(v)) for v in classes]), prediction.cast("int") + 1)
    shares = vector_to_array("probability") if "probability" in scored.columns else F.lit(None).cast("array<double>")
    return scored.select(
        *[quoted(k) for k in keys], prediction.alias("prediction"), F.array_max(shares).alias("confidence"), shares.alias("probabilities")
    )
