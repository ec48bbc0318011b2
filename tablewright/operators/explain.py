"""Explaining fitted models and their predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.profile import correlations
from tablewright.plans import wide
from tablewright.plans.ordered import row_numbers, running_sums
from tablewright.plans.types import known, quoted

TOP_FEATURES = 20


def feature_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, population deviation, extremes, range and coefficient of variation per feature."""
    mean = lambda c: F.avg(known(df, c))
    std = lambda c: F.stddev_pop(known(df, c))
    low = lambda c: F.min(known(df, c)).cast("double")
    high = lambda c: F.max(known(df, c)).cast("double")
    return wide.unpivot_stats(
        df,
        features,
        {
            "mean": mean,
            "std": std,
            "min": low,
            "max": high,
            "range": lambda c: high(c) - low(c),
            "cv": lambda c: std(c) / F.greatest(F.abs(mean(c)), F.lit(1e-10)),
        },
        label="feature",
    )


def confidence(df: DataFrame, probabilities: Sequence[str], low: float = 0.6) -> DataFrame:
    """Mean, extremes and deviation of the largest class probability and how many rows stay below ``low``."""
    best = F.array_max(F.array(*[quoted(c).cast("double") for c in probabilities]))
    return df.agg(
        F.avg(best).alias("mean_confidence"),
        F.min(best).alias("min_confidence"),
        F.max(best).alias("max_confidence"),
        F.stddev_pop(best).alias("std_confidence"),
        F.count_if(best < low).alias("low_confidence_count"),
        F.count("*").alias("total_predictions"),
    )


def feature_interactions(df: DataFrame, features: Sequence[str], first: int = 5, weak: float = 0.3, strong: float = 0.7) -> DataFrame:
    """Correlated pairs among the first features."""
    pairs = correlations(df, list(features)[:first]).where(F.abs("r") > weak)
    return pairs.withColumn("strength", F.when(F.abs("r") > strong, "strong").otherwise("moderate"))


def agreement(first: DataFrame, second: DataFrame, n: int = 10) -> DataFrame:
    """Share of features with the same sign in the ``n`` strongest of two attribution tables (feature, value)."""
    top = lambda df: df.orderBy(F.desc(F.abs("value")), "feature").limit(n)
    a = top(first).select("feature", (F.col("value") >= 0).alias("up"))
    b = top(second).select("feature", (F.col("value") >= 0).alias("up"))
    same = a.join(F.broadcast(b), ["feature", "up"]).agg(F.count("*").alias("same"))
    sizes = a.agg(F.count("*").alias("na")).join(b.agg(F.count("*").alias("nb")), F.col("na") >= 0)
    score = F.col("same") / F.greatest(F.least("na", "nb"), F.lit(1))
    out = same.join(sizes, F.col("same") >= 0).select(F.round(score, 4).alias("agreement"))
    level = F.when(F.col("agreement") > 0.7, "high").when(F.col("agreement") > 0.4, "moderate").otherwise("low")
    return out.withColumn("consistency", level)


def cumulative_importance(importances: DataFrame) -> DataFrame:
    """How many of the strongest features (feature, importance) reach 50 % and 90 % of the total."""
    total = importances.agg(F.sum("importance")).first()[0] or 0.0
    ranked = importances.select("feature", (-F.col("importance")).alias("weakness"), "importance")
    reached = running_sums(ranked, ["weakness", "feature"], {"reached": F.col("importance")})
    # the features that still lie below the mark, and the one that passes it
    need = lambda s: F.count_if(F.col("reached") < F.lit(total) * (s - 1e-12)) + 1
    return reached.agg(need(0.5).alias("features_for_50pct"), need(0.9).alias("features_for_90pct"), F.count("*").alias("total_features"))


def _strengths(model: object) -> list[float] | None:
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return [float(v) for v in model.coefficientMatrix.toArray()[0]]
    if hasattr(model, "coefficients"):
        return [float(v) for v in model.coefficients.toArray()]
    return None


def feature_importance(df: DataFrame, model: object, names: Sequence[str], top: int = TOP_FEATURES, signed: bool = True) -> DataFrame:
    """Importance per feature, strongest first, with its share of the largest; no rows for models without any."""
    values = _strengths(model) or []
    if len(values) != len(names):
        values = []
    if not signed and hasattr(model, "coefficientMatrix") and values:
        values = [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    largest = max((abs(v) for v in values), default=0.0)
    rows = [(n, v, abs(v) / largest if largest else 0.0) for n, v in zip(names, values)]
    rows.sort(key=lambda x: (-abs(x[1]), x[0]))
    return wide.rows_frame(df.sparkSession, rows[:top], "feature string, importance double, normalized double")


def _predicted(model: Transformer, df: DataFrame, values: Column, output: str) -> DataFrame:
    """The model applied to feature arrays."""
    return model.transform(df.withColumn("features", array_to_vector(values))).withColumnRenamed("prediction", output)


def permutation_attribution(df: DataFrame, model: Transformer, features: Sequence[str], key: str, signs: Mapping[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Per feature the mean change of the prediction when its column is shuffled over all rows.

    Both row orders come from hashes of the key; the shuffled partner is found by one join on row numbers, which
    are unique, so no key is hot.
    """
    columns = [quoted(c).cast("double") for c in features]
    base = df.select(F.col(key).alias("_k"), F.array(*columns).alias("_x"))
    total = base.count()
    straight = base.withColumn("_h", F.xxhash64(F.lit(seed), "_k"))
    mixed = base.withColumn("_h", F.xxhash64(F.lit(seed + 1), "_k"))
    left = row_numbers(straight, ["_h", "_k"], "_n", rows=total).select("_n", "_x")
    right = row_numbers(mixed, ["_h", "_k"], "_n", rows=total).select("_n", F.col("_x").alias("_other"))
    pairs = left.join(right, "_n")
    before = _predicted(model, pairs, F.col("_x"), "_before").select("_x", "_other", "_before")
    places = F.array(*[F.lit(i) for i in range(len(features))])
    each = before.withColumn("_i", F.explode(places))
    moved = F.transform("_x", lambda v, i: F.when(i == F.col("_i"), F.element_at("_other", F.col("_i") + 1)).otherwise(v))
    after = _predicted(model, each, moved, "_after")
    means = after.groupBy("_i").agg(F.avg(F.col("_before") - F.col("_after")).alias("attribution"))
    names = F.array(*[F.lit(c) for c in features])
    out = means.select(F.element_at(names, F.col("_i") + 1).alias("feature"), "attribution")
    if signs:
        # a linear model tells the direction, the shuffle only the size
        sign = F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(1.0 if v >= 0 else -1.0))])
        out = out.withColumn("attribution", F.abs("attribution") * F.coalesce(F.try_element_at(sign, F.col("feature")), F.lit(1.0)))
    return out


def local_attribution(df: DataFrame, model: Transformer, features: Sequence[str], key: str, background: Mapping[str, float]) -> DataFrame:
    """Per row and feature: prediction minus the prediction with the feature at its background value."""
    columns = [quoted(c).cast("double") for c in features]
    base = df.select(F.col(key).alias("key"), F.array(*columns).alias("_x"))
    scored = _predicted(model, base, F.col("_x"), "_before").select("key", "_x", "_before")
    rest = F.array(*[F.lit(float(background[c])) for c in features])
    each = scored.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(len(features))])))
    moved = F.transform("_x", lambda v, i: F.when(i == F.col("_i"), F.element_at(rest, F.col("_i") + 1)).otherwise(v))
    after = _predicted(model, each, moved, "_after")
    names = F.array(*[F.lit(c) for c in features])
    return after.select("key", F.element_at(names, F.col("_i") + 1).alias("feature"), (F.col("_before") - F.col("_after")).alias("attribution"))
