"""Evaluation of predictions.  Input is a table of rows with the truth, the prediction and, where needed, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.prep import CLASS_LIMIT
from tablewright.operators.relational import sample_evenly
from tablewright.plans.ordered import running_sums
from tablewright.plans.types import quoted

EPSILON = 2.220446049250313e-16
CURVE_POINTS = 300
MAX_ROWS = 50_000


def _cells(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows (actual, predicted, cnt): everything the label metrics need, one row per label pair."""
    return df.groupBy(
        quoted(truth).cast("string").alias("actual"), quoted(predicted).cast("string").alias("predicted")
    ).agg(F.count("*").alias("cnt"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts for every pair of labels, zeros kept, labels as text."""
    cells = _cells(df, truth, predicted)
    found = cells.select(F.explode(F.array("actual", "predicted")).alias("v")).distinct().limit(CLASS_LIMIT + 1).collect()
    if len(found) > CLASS_LIMIT:
        raise ValueError(f"more than {CLASS_LIMIT} labels")
    names = F.array(*[F.lit(v) for v in sorted(r["v"] for r in found)])
    grid = df.sparkSession.range(1).select(F.explode(names).alias("actual")).select("actual", F.explode(names).alias("predicted"))
    return grid.join(F.broadcast(cells), ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label: support, number predicted, hits, precision, recall and F1 (0 where undefined)."""
    cells = _cells(df, truth, predicted)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("cnt").alias("support"), F.lit(0).cast("bigint").alias("predicted_as")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("cnt").alias("predicted_as")),
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0)
    per = (
        cells.withColumn("hit", hit)
        .select("hit", F.explode(sides).alias("s"))
        .groupBy("s.label")
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted_as").alias("predicted_as"),
            # a hit lies on both sides of its label
            F.sum(F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0)).alias("hits"),
        )
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("hits"), F.col("predicted_as")), share(F.col("hits"), F.col("support"))
    return per.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", share(2 * F.col("hits").cast("double"), F.col("predicted_as") + F.col("support"))
    )


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, Matthews correlation and Cohen's kappa in one row."""
    per = class_report(df, truth, predicted)
    n, hits = F.sum("support").cast("double"), F.sum("hits").cast("double")
    tt = F.sum(F.col("support").cast("double") * F.col("support"))
    pp = F.sum(F.col("predicted_as").cast("double") * F.col("predicted_as"))
    tp = F.sum(F.col("support").cast("double") * F.col("predicted_as"))
    sums = per.agg(
        n.alias("n"), hits.alias("hits"), tt.alias("tt"), pp.alias("pp"), tp.alias("tp"),
        *[(F.sum(F.col("support") * F.col(c)) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
    )
    c = F.col
    spread = F.sqrt((c("n") * c("n") - c("pp")) * (c("n") * c("n") - c("tt")))
    expected = c("tp") / (c("n") * c("n"))
    observed = c("hits") / c("n")
    return sums.select(
        observed.alias("accuracy"),
        "precision",
        "recall",
        "f1",
        F.when(spread > 0, (c("hits") * c("n") - c("tp")) / spread).otherwise(0.0).alias("mcc"),
        F.when(expected < 1, (observed - expected) / (1 - expected)).alias("cohen_kappa"),
    )


def log_loss(df: DataFrame, truth: str, probabilities: Mapping[object, str]) -> DataFrame:
    """Mean negative log of the probability given to the true label, clipped away from 0 and 1."""
    p = F.lit(None).cast("double")
    for label, column in probabilities.items():
        p = F.when(quoted(truth) == F.lit(label), quoted(column)).otherwise(p)
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.agg((-F.avg(F.ln(clipped))).alias("log_loss"))


def one_vs_rest(df: DataFrame, truth: str, probabilities: Mapping[object, str]) -> DataFrame:
    """Rows (label, score, positives, negatives): the scores of every label with their counts."""
    pairs = F.array(
        *[
            F.struct(F.lit(str(v)).alias("label"), quoted(c).cast("double").alias("score"), (quoted(truth) == F.lit(v)).alias("hit"))
            for v, c in probabilities.items()
        ]
    )
    return df.select(F.inline(pairs)).groupBy("label", "score").agg(
        F.count_if(F.col("hit")).alias("positives"), F.count_if(~F.col("hit")).alias("negatives")
    )


def curve_points(df: DataFrame, truth: str, probabilities: Mapping[object, str]) -> DataFrame:
    """True and false positives at every distinct score of every label, with the label's totals.

    The table is reduced to distinct scores first; the running totals then go chunk by chunk.
    """
    counted = one_vs_rest(df, truth, probabilities)
    points = running_sums(
        counted, ["score"], {"tp": F.col("positives"), "fp": F.col("negatives")}, descending=True, partition_by=["label"]
    )
    totals = counted.groupBy("label").agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    return points.join(F.broadcast(totals), "label")  # one row per label


def _binary(truth_positive: object, score: str) -> dict:
    return {truth_positive: score}


def roc_curve(df: DataFrame, truth: str, probabilities: Mapping[object, str]) -> DataFrame:
    """False and true positive rate at every distinct score, per label (one label for a binary curve)."""
    points = curve_points(df, truth, probabilities)
    return points.select("label", "score", (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def roc_auc(df: DataFrame, truth: str, probabilities: Mapping[object, str]) -> DataFrame:
    """Area under the ROC curve per label; equal scores count half."""
    points = curve_points(df, truth, probabilities)
    area = F.sum(F.col("negatives").cast("double") * (F.col("tp") - F.col("positives") / 2.0))
    return points.groupBy("label").agg((area / (F.first("p").cast("double") * F.first("n"))).alias("auc"), F.first("p").alias("support"))


def average_auc(per_label: DataFrame) -> DataFrame:
    """Macro and support-weighted mean of the label areas."""
    return per_label.agg(
        F.avg("auc").alias("macro_auc"), (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("weighted_auc")
    )


def pr_curve(df: DataFrame, truth: str, probabilities: Mapping[object, str]) -> DataFrame:
    """Precision and recall at every distinct score, per label."""
    points = curve_points(df, truth, probabilities)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.select("label", "score", precision.alias("precision"), (F.col("tp") / F.col("p")).alias("recall"))


def average_precision(df: DataFrame, truth: str, probabilities: Mapping[object, str]) -> DataFrame:
    """Sum of precision times the gain in recall, per label."""
    points = curve_points(df, truth, probabilities)
    step = F.col("positives") / F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return points.groupBy("label").agg(F.sum(step).alias("average_precision"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, MSE, RMSE, R2, MAPE (non-zero truths) and SMAPE in one row, from one scan."""
    y, p = quoted(truth).cast("double"), quoted(predicted).cast("double")
    error = y - p
    mse = F.avg(error * error)
    smape = F.avg(2 * F.abs(error) / (F.abs(y) + F.abs(p) + 1e-8)) * 100
    return df.agg(
        F.avg(F.abs(error)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (1 - mse / F.var_pop(y)).alias("r2"),
        (F.avg(F.when(y != 0, F.abs(error / y))) * 100).alias("mape"),
        smape.alias("smape"),
    )


def residuals(df: DataFrame, truth: str, predicted: str, order_by: Sequence[str], points: int = CURVE_POINTS) -> DataFrame:
    """Evenly drawn rows with their residual, next to its mean and population deviation over all rows."""
    gap = quoted(truth).cast("double") - quoted(predicted).cast("double")
    mean, std = df.agg(F.avg(gap), F.stddev_pop(gap)).first()
    drawn = sample_evenly(df, order_by, points)
    return drawn.select(
        *[quoted(c) for c in order_by],
        quoted(truth).alias("actual"),
        quoted(predicted).alias("predicted"),
        gap.alias("residual"),
        F.lit(mean).alias("mean_residual"),
        F.lit(std).alias("std_residual"),
    )


def predicted_classes(df: DataFrame, predicted: str) -> DataFrame:
    """Count and share of every predicted label."""
    total = df.count()
    counts = df.groupBy(quoted(predicted).cast("string").alias("label")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("pct", F.round(F.col("cnt") * 100 / F.lit(total), 1))


def predicted_values(df: DataFrame, predicted: str) -> DataFrame:
    """Mean, population deviation, minimum and maximum of the predictions."""
    p = quoted(predicted)
    return df.agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))


def prediction_samples(df: DataFrame, truth: str, predicted: str, order_by: Sequence[str], task: str, n: int = 50) -> DataFrame:
    """Evenly drawn rows: right or wrong for classes, residual and absolute error for values."""
    keys = [quoted(c) for c in order_by]
    drawn = sample_evenly(df, order_by, n)
    y, p = quoted(truth), quoted(predicted)
    if task == "classification":
        return drawn.select(*keys, y.alias("actual"), p.alias("predicted"), (y == p).alias("correct"))
    return drawn.select(
        *keys, y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"), F.abs(y - p).alias("abs_error")
    )


def limit_rows(df: DataFrame, order_by: Sequence[str], ceiling: int | None = None) -> DataFrame:
    """Evenly thin the rows to ``ceiling``; without one (the default) the table is evaluated whole."""
    return df if ceiling is None else sample_evenly(df, order_by, ceiling)


# --- insights ---------------------------------------------------------------------------------------

# Lower limits of the performance bands
ACCURACY_BANDS = {"excellent": 0.95, "strong": 0.85, "moderate": 0.70}
R2_BANDS = {"excellent": 0.90, "strong": 0.75, "moderate": 0.50}
SCORES = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _band(value: Column, bands: Mapping[str, float]) -> Column:
    out = F.lit("weak")
    for name, limit in reversed(bands.items()):
        out = F.when(value >= limit, name).otherwise(out)
    return out


def insights(records: DataFrame, key: str) -> DataFrame:
    """Rule-based observations on a table of evaluation records, as rows (key, category, severity, title, detail).

    Rules whose columns are absent or null give no row.
    """
    have = set(records.columns)
    c = F.col
    classes, values = c("task_type") == "classification", c("task_type") == "regression"
    rules: list[tuple[str, Column, Column, Column, Column]] = []

    def rule(category: str, needs: Sequence[str], when: Column, severity: Column | str, title: Column | str, detail: Column) -> None:
        if set(needs) <= have:
            known = when
            for n in needs:
                known = known & c(n).isNotNull()
            text = lambda v: F.lit(v) if isinstance(v, str) else v
            rules.append((category, known, text(severity), text(title), detail.cast("string")))

    points = lambda a, b: F.round((c(a) - c(b)) * 100, 2)
    rule("evaluation", ["test_size"], c("test_size") > 0, "info", "Evaluation basis", c("test_size"))
    scored = [s for s in SCORES if s in have]
    if scored:
        pairs = [F.struct(c(s).alias("v"), F.lit(-i).alias("first"), F.lit(s).alias("name")) for i, s in enumerate(scored)]
        low = [F.struct(c(s).alias("v"), F.lit(i).alias("first"), F.lit(s).alias("name")) for i, s in enumerate(scored)]
        known = [F.filter(F.array(*p), lambda x: x["v"].isNotNull()) for p in (pairs, low)]
        text = F.concat_ws(" > ", F.array_max(known[0])["name"], F.array_min(known[1])["name"])
        rules.append(("performance", classes & (F.size(known[0]) > 0), F.lit("info"), F.lit("Strongest and weakest metric"), text))
    a = c("accuracy") if "accuracy" in have else F.lit(None)
    rule("performance", ["accuracy"], classes, F.when(a >= 0.85, "positive").when(a < 0.70, "warning").otherwise("info"),
         F.concat(F.lit("Overall correctness: "), _band(a, ACCURACY_BANDS)), F.round(a, 4))
    if {"precision", "recall"} <= have:
        gap = c("precision") - c("recall")
        rule("error_pattern", ["precision", "recall"], classes, F.when(F.abs(gap) < 0.05, "info").otherwise("warning"),
             "Precision/recall balance", points("precision", "recall"))
    rule("performance", ["log_loss"], classes, "info", "Probability calibration", F.round(c("log_loss"), 4) if "log_loss" in have else F.lit(""))
    if "roc_auc" in have:
        rules.append(("performance", classes & c("roc_auc").isNull(), F.lit("warning"), F.lit("ROC-AUC unavailable"), F.lit("")))
    if {"top_error_count", "test_size"} <= have:
        wrong = c("top_error_count") > 0
        rule("error_pattern", ["top_error_count", "test_size"], classes, F.when(wrong, "info").otherwise("positive"),
             F.when(wrong, "Most frequent misclassification").otherwise("No misclassifications"), c("top_error_count"))
    if {"majority", "minority"} <= have:
        ratio = F.try_divide(c("majority"), c("minority"))
        rule("data", ["majority", "minority"], classes & (F.coalesce(ratio, F.lit(float("inf"))) >= 3),
             F.when(ratio < 10, "info").otherwise("warning"), F.when(ratio < 10, "Moderate class imbalance").otherwise("Severe class imbalance"),
             F.round(ratio, 2))
    r2 = c("r2") if "r2" in have else F.lit(None)
    rule("performance", ["r2"], values, F.when(r2 >= 0.75, "positive").when(r2 < 0.5, "warning").otherwise("info"),
         F.concat(F.lit("Variance explained: "), _band(r2, R2_BANDS)), F.round(r2, 4))
    if {"rmse", "mae"} <= have:
        tail = F.coalesce(F.try_divide(c("rmse"), c("mae")) >= 1.5, F.lit(False))
        rule("error_pattern", ["rmse", "mae"], values, F.when(tail, "warning").otherwise("info"),
             F.when(tail, "Heavy error tail").otherwise("Error magnitude"), F.round(c("mae"), 4))
    if "mape" in have:
        rules.append(("performance", values, F.lit("info"), F.when(c("mape").isNull(), "MAPE unavailable").otherwise("Percentage error"),
                      F.coalesce(F.round(c("mape"), 2).cast("string"), F.lit(""))))
    if {"mean_residual", "std_residual"} <= have:
        rule("error_pattern", ["mean_residual", "std_residual"],
             values & (c("std_residual") > 0) & (F.abs("mean_residual") > 0.1 * c("std_residual")), "warning", "Systematic bias",
             F.when(c("mean_residual") < 0, "high").otherwise("low"))
    if "top3_share" in have:
        rule("features", ["top3_share"], F.lit(True), "info", F.when(c("top3_share") >= 70, "Concentrated features").otherwise("Dominant features"),
             F.round(c("top3_share"), 1))
    if {"train_score", "validation_score"} <= have:
        over = c("train_score") - c("validation_score")
        rule("overfitting", ["train_score", "validation_score"], F.lit(True), F.when(over > 0.10, "warning").otherwise("positive"),
             F.when(over > 0.10, "Possible overfitting").otherwise("No clear overfitting"), F.round(over, 4))
    rows = F.array(
        *[
            F.when(
                when,
                F.struct(F.lit(cat).alias("category"), sev.alias("severity"), title.alias("title"), detail.alias("detail")),
            )
            for cat, when, sev, title, detail in rules
        ]
    )
    found = records.select(quoted(key), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_i"))
    return found.select(quoted(key), "_i.*")
