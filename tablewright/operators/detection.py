"""Finding the likely target, the kind of task, and what stands in the way of training."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.operators.profile import duplicate_extras, numeric_summary
from tablewright.plans import wide
from tablewright.plans.counts import distinct_counts
from tablewright.plans.types import is_numeric, known, numeric_columns, quoted

# Name hints per scoring rule
RATIO_HINTS = [
    "target", "label", "class", "diagnosis", "outcome", "result", "y", "approved",
    "churn", "default", "fraud", "survived", "price", "cost", "score", "rating",
]
ENGINE_HINTS = [
    "target", "label", "class", "diagnosis", "outcome", "result", "y", "approved",
    "churn", "default", "fraud", "survived", "price", "cost",
]
EVALUATION_HINTS = [
    "target", "label", "class", "y", "outcome", "result", "prediction", "price", "sales", "revenue", "churn",
    "status", "response", "purchased", "deposit", "default", "attrition", "survived", "salary", "score",
]
ID_NAMES = [
    "id", "uuid", "index", "rowid", "productid", "customerid", "userid", "accountid", "patientid", "transactionid",
]
NAME_ONLY_HINTS = ["target", "label", "class", "churn", "outcome", "survived", "status", "price", "salary", "score"]


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _filled(df: DataFrame) -> tuple[int, dict[str, int]]:
    got = wide.fetch(df, {"": F.count("*"), **{c: F.count(known(df, c)) for c in df.columns}})
    return got.pop(""), got


def target_scores(df: DataFrame, rule: str = "evaluation") -> DataFrame:
    """Score of every column as the likely target, by one of the rules ratio, engine, evaluation or name."""
    total, filled = _filled(df)
    unique = distinct_counts(df, df.columns)
    numbers = set(numeric_columns(df))
    rows = []
    for position, c in enumerate(df.columns):
        n, u, name = filled[c], unique[c], c.strip().lower()
        if rule in ("ratio", "engine"):
            if n < 2:
                continue
            share = u / n
            slope = 1.0 if rule == "ratio" else 0.5
            top = 10.0 if rule == "ratio" else 9.0
            score = 0.0
            if share <= 0.05 and u <= 30:
                score = 10 - 10 * share
            elif c in numbers and u <= 20:
                score = top - 10 * slope * share
            elif _is_text(df, c) and u <= 30:
                score = 8 - (8 if rule == "ratio" else 5) * share
            elif rule == "engine" and c in numbers:
                score = 4.0
            if score <= 0:
                continue
            score = round(score, 2) if rule == "ratio" else score
            for hint in RATIO_HINTS if rule == "ratio" else ENGINE_HINTS:
                if hint in name:
                    score = min(10.0, score + 2)
        elif rule == "evaluation":
            share = u / total if total else 0.0
            looks_id = name in ID_NAMES or (name.endswith("id") and name != "hybrid")
            score = 0.0
            if looks_id or (share >= 0.9 and total >= 10 and _is_text(df, c)):
                score -= 100
            if name in EVALUATION_HINTS:
                score += 60
            elif any(hint in name for hint in EVALUATION_HINTS):
                score += 35
            if position == len(df.columns) - 1 and not looks_id:
                score += 20
            if 2 <= u <= 20:
                score += 25
            elif u > 20 and c in numbers and not looks_id:
                score += 15
        elif rule == "name":
            score = 1.0 if any(hint in name for hint in NAME_ONLY_HINTS) else 0.0
            if position == len(df.columns) - 1:
                score += 0.5  # the last column is the fallback
        else:
            raise ValueError(f"unknown rule {rule!r}")
        rows.append((c, position, float(round(score, 2)), u))
    frame = wide.rows_frame(df.sparkSession, rows, "column_name string, position int, score double, unique_values bigint")
    limits = {"ratio": 5, "engine": 6}
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "position")  # one row per column
    frame = frame.withColumn("place", F.row_number().over(best))
    if rule in limits:
        frame = frame.where(F.col("place") <= limits[rule])
    if rule == "evaluation":
        confidence = F.when(F.col("score") >= 40, "High").when(F.col("score") >= 15, "Medium").otherwise("Low")
        frame = frame.withColumn("confidence", confidence)
    return frame


def suggest_target(df: DataFrame, rule: str = "evaluation") -> str:
    return target_scores(df, rule).where(F.col("place") == 1).first()["column_name"]


def task_type(df: DataFrame, target: str, rule: str = "training") -> str:
    """classification or regression; the rules differ in how many whole-numbered classes they accept."""
    if not is_numeric(df.schema[target].dataType):
        return "classification"
    value = known(df, target)
    got = wide.fetch(df, {"rows": F.count("*"), "n": F.count(value), "whole": F.bool_and(value % 1 == 0)})
    if not got["n"]:
        return "classification"
    u = distinct_counts(df, [target])[target]
    few = u <= 20 or (rule == "evaluation" and u <= 50 and u / max(got["rows"], 1) <= 0.05)
    return "classification" if got["whole"] and few else "regression"


def task_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Task that each column would be as a target, by the training, evaluation and recommendation rules."""
    columns = df.columns if columns is None else columns
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    got = wide.fetch(
        df, {"": F.count("*"), **{c: F.coalesce(F.bool_and(known(df, c) % 1 == 0), F.lit(True)) for c in numbers}}
    )
    total, unique = got[""], distinct_counts(df, columns)
    rows = []
    for c in columns:
        u, text = unique[c], c not in numbers
        whole = not text and got[c]
        name = lambda ok: "classification" if ok else "regression"
        rows.append(
            (
                c,
                u,
                name(text or (whole and u <= 20)),
                name(text or (whole and (u <= 20 or (u <= 50 and u / max(total, 1) <= 0.05)))),
                name(text or (whole and u <= 20)),
                not text and whole and 15 < u <= 30,
            )
        )
    return wide.rows_frame(
        df.sparkSession,
        rows,
        "column_name string, unique_values bigint, training string, evaluation string, recommendation string, ambiguous boolean",
    )


def analyze_target(df: DataFrame, target: str, task: str | None = None, folds: int = 5) -> DataFrame:
    """Class counts, cardinality flags and the number of folds that is safe for a target (one row)."""
    task = task or task_type(df, target)
    value = known(df, target)
    groups = df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    class_n = F.when(F.col("v").isNotNull(), F.col("n"))
    out = groups.agg(
        F.sum("n").alias("total_samples"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("v").alias("n_classes"),
        F.coalesce(F.min(class_n), F.lit(0)).alias("min_class_count"),
        F.coalesce(F.max(class_n), F.lit(0)).alias("max_class_count"),
    )
    share = F.col("n_classes") / F.col("total_samples")
    classes = F.lit(task == "classification")
    blocked = classes & (F.col("min_class_count") < 2)
    folds = max(1, folds)
    limit = F.when(classes, F.col("min_class_count")).otherwise(10)
    safe = F.greatest(F.lit(2), F.least(F.lit(folds), limit)).cast("int")
    return out.select(
        F.lit(target).alias("target_column"),
        F.lit(task).alias("task_type"),
        "*",
        ((F.col("n_classes") > 50) & (share > 0.5)).alias("high_cardinality"),
        ((F.col("n_classes") >= 2) & (share >= 0.9)).alias("identifier_like"),
        blocked.alias("blocked"),
        F.when(blocked, folds).otherwise(safe).cast("int").alias("safe_folds"),
        (~blocked & (safe < F.when(classes, min(folds, 10)).otherwise(folds))).alias("folds_adjusted"),
    )


def validate_target(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """One row per check of a training table: check, passed."""
    task = task or task_type(df, target)
    value = known(df, target)
    numeric = is_numeric(df.schema[target].dataType)
    number = value.cast("double") if numeric else quoted(target).cast("string").try_cast("double")
    got = wide.fetch(
        df,
        {
            "rows": F.count("*"),
            "n": F.count(value),
            "fraction": F.coalesce(F.bool_or(number % 1 != 0), F.lit(False)),
            "numbers": F.count(number),
            "std": F.stddev_samp(number),
        },
    )
    u = distinct_counts(df, [target])[target]
    checks = [
        ("enough_rows", got["rows"] >= 5),
        ("enough_columns", len(df.columns) >= 2),
        ("enough_known_targets", got["n"] >= 4),
        ("target_varies", u > 1),
    ]
    if task == "classification":
        checks.append(("whole_classes", not (numeric and got["fraction"])))
        checks.append(("few_classes", not (numeric and u > 50 and u / max(got["n"], 1) > 0.5)))
    else:
        checks.append(("numeric_target", got["n"] - got["numbers"] <= 0.2 * got["n"]))
        checks.append(("target_spread", bool(got["std"])))
    return wide.rows_frame(df.sparkSession, checks, "check string, passed boolean")


def require_valid_target(df: DataFrame, target: str, task: str | None = None) -> None:
    failed = [r["check"] for r in validate_target(df, target, task).where(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"target {target!r} is not usable: {', '.join(failed)}")


def dataset_recommendations(df: DataFrame, target: str) -> DataFrame:
    """Issues before training (with the rows or columns concerned) and the size class of the table."""
    total, filled = _filled(df)
    missing = {c: total - n for c, n in filled.items()}
    gaps = {c: n for c, n in missing.items() if n}
    rows = []
    if gaps:
        worst = max(gaps.values()) / total * 100
        rows.append(("missing_values", "high" if worst > 30 else "medium", len(gaps)))
    if missing[target]:
        rows.append(("null_target", "high", missing[target]))
    extras = duplicate_extras(df).first()["extra_rows"]
    if extras:
        rows.append(("duplicate_rows", "low", extras))
    if task_type(df, target) == "classification":
        sizes = df.where(known(df, target).isNotNull()).groupBy(quoted(target)).agg(F.count("*").alias("n"))
        ends = sizes.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("k")).first()
        if ends["k"] > 1 and ends["b"] / ends["a"] > 3:
            rows.append(("class_imbalance", "medium", ends["k"]))
    unique = distinct_counts(df, [c for c in df.columns if c != target])
    constant = sum(1 for u in unique.values() if u <= 1)
    if constant:
        rows.append(("constant_features", "medium", constant))
    cells = total * len(df.columns)
    size = "small" if cells < 20_000 else "medium" if cells < 200_000 else "large"
    rows.append((f"size_{size}", "info", cells))
    return wide.rows_frame(df.sparkSession, rows, "issue string, severity string, concerned bigint")


ID_LIKE = re.compile(r"(id|index|_id|row_num|serial)", re.IGNORECASE)


def removal_advice(df: DataFrame) -> DataFrame:
    """Columns worth dropping: mostly missing, nearly constant, or named like an identifier."""
    total, filled = _filled(df)
    numbers = numeric_summary(df, outliers=False)
    rows = [(c, "high_missing") for c, n in filled.items() if (total - n) / max(total, 1) * 100 > 50]
    rows += [(c, "low_variance") for c, s in numbers.items() if s["std"] and 0 < s["std"] < 0.01]
    rows += [(c, "identifier") for c in df.columns if ID_LIKE.match(c)]
    return wide.rows_frame(df.sparkSession, rows, "column_name string, reason string")
