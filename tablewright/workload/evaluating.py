"""Evaluation queries on stand-in predictions."""

from pyspark.sql import functions as F

from tablewright.operators import evaluate as e
from tablewright.operators.profile import class_share
from tablewright.plans.types import rounded
from tablewright.workload.fragments import r
from tablewright.workload.registry import query

# three classes: the flag against a guess from discount and status, with made-up but consistent probabilities
GUESSES = """SELECT l_returnflag AS y, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_linestatus = 'F' THEN 'N' ELSE 'R' END AS p,
    (l_discount + 0.01) / (l_discount + l_tax + l_quantity / 500 + 0.03) AS pa, (l_tax + 0.01) / (l_discount + l_tax + l_quantity / 500 + 0.03) AS pn,
    (l_quantity / 500 + 0.01) / (l_discount + l_tax + l_quantity / 500 + 0.03) AS pr FROM lineitem"""
PROBS = {"A": "pa", "N": "pn", "R": "pr"}
G = f"WITH t AS ({GUESSES})"

# two classes: is the event a purchase, scored by its value (many equal scores)
BINARY = "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, floor(value) / 500 AS score FROM events"
N = f"WITH t AS ({BINARY})"

# values: price of a line against a constant price per unit
PRICES = "SELECT o_orderkey AS id, o_totalprice AS y, 150000 + o_custkey * 2e0 AS p FROM orders"
P = f"WITH t AS ({PRICES})"


def guesses(t):
    return t.sql(GUESSES, "lineitem")


def binary(t):
    return t.sql(BINARY, "events")


def prices(t):
    return t.sql(PRICES, "orders")


@query(
    "confusion_matrix",
    G + """, l AS (SELECT DISTINCT v FROM (SELECT y AS v FROM t UNION SELECT p FROM t)), c AS (SELECT y, p, count(*) AS n FROM t GROUP BY ALL)
    SELECT a.v AS actual, b.v AS predicted, coalesce(n, 0) AS cnt FROM l a JOIN l b ON TRUE LEFT JOIN c ON c.y = a.v AND c.p = b.v""",
)
def _(t):
    return e.confusion_matrix(guesses(t), "y", "p")


@query("accuracy", G + f"SELECT {r('avg(CAST(y = p AS INTEGER))')} AS accuracy FROM t")
def _(t):
    return e.classification_metrics(guesses(t), "y", "p").select(rounded(F.col("accuracy")).alias("accuracy"))


_PER = """c AS (SELECT y, p, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT y AS v FROM c UNION SELECT p FROM c),
    k AS (SELECT v, coalesce((SELECT sum(n) FROM c WHERE y = v), 0) AS sup, coalesce((SELECT sum(n) FROM c WHERE p = v), 0) AS pre,
      coalesce((SELECT sum(n) FROM c WHERE y = v AND p = v), 0) AS hit FROM l),
    m AS (SELECT *, CASE WHEN pre > 0 THEN hit / pre ELSE 0 END AS pr, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS re,
      CASE WHEN pre + sup > 0 THEN 2.0 * hit / (pre + sup) ELSE 0 END AS f FROM k)"""


@query("class_report", G + f", {_PER} SELECT v AS label, CAST(sup AS BIGINT) AS support, CAST(hit AS BIGINT) AS hits, {r('pr')} AS precision, {r('re')} AS recall, {r('f')} AS f1 FROM m")
def _(t):
    df = e.class_report(guesses(t), "y", "p").drop("predicted_as")
    return df.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1")})


@query("precision_recall_f1_weighted", G + f", {_PER} SELECT {r('sum(sup * pr) / sum(sup)')} AS precision, {r('sum(sup * re) / sum(sup)')} AS recall, {r('sum(sup * f) / sum(sup)')} AS f1 FROM m")
def _(t):
    df = e.classification_metrics(guesses(t), "y", "p")
    return df.select(*[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


_MCC = "(sum(hit) * sum(sup) - sum(sup * pre)) / sqrt(CAST(sum(sup) * sum(sup) - sum(pre * pre) AS DOUBLE) * CAST(sum(sup) * sum(sup) - sum(sup * sup) AS DOUBLE))"


@query("mcc", G + f", {_PER} SELECT {r(_MCC)} AS mcc FROM m")
def _(t):
    return e.classification_metrics(guesses(t), "y", "p").select(rounded(F.col("mcc")).alias("mcc"))


@query("mcc_binary", f"WITH t AS (SELECT quality AS y, toxic AS p FROM labels), {_PER} SELECT {r(_MCC)} AS mcc FROM m")
def _(t):
    return e.classification_metrics(t("labels"), "quality", "toxic").select(rounded(F.col("mcc")).alias("mcc"))


@query(
    "cohen_kappa",
    G + f""", {_PER}, o AS (SELECT sum(hit) / sum(sup) AS po, sum(sup * pre) / CAST(sum(sup) * sum(sup) AS DOUBLE) AS pe FROM m)
    SELECT {r('(po - pe) / (1 - pe)')} AS cohen_kappa FROM o""",
)
def _(t):
    return e.classification_metrics(guesses(t), "y", "p").select(rounded(F.col("cohen_kappa")).alias("cohen_kappa"))


_TRUE = "CASE y WHEN 'A' THEN pa WHEN 'N' THEN pn ELSE pr END"


@query("log_loss", G + f"SELECT {r(f'-avg(ln(greatest({_TRUE}, 2.220446049250313e-16)))')} AS log_loss FROM t")
def _(t):
    return e.log_loss(guesses(t), "y", PROBS).select(rounded(F.col("log_loss")).alias("log_loss"))


_POINTS = """g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM t GROUP BY score),
    w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@query("roc_curve", N + f", {_POINTS} SELECT '1' AS label, score, {r('fp / n')} AS fpr, {r('tp / p')} AS tpr FROM w")
def _(t):
    df = e.roc_curve(binary(t), "y", {1: "score"})
    return df.withColumns({c: rounded(F.col(c)) for c in ("fpr", "tpr")})


@query("roc_auc", N + f", {_POINTS} SELECT '1' AS label, {r('sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n))')} AS auc FROM w")
def _(t):
    return e.roc_auc(binary(t), "y", {1: "score"}).select("label", rounded(F.col("auc")).alias("auc"))


_OVR = "o AS (" + " UNION ALL ".join(f"SELECT '{v}' AS label, CAST({c} AS DOUBLE) AS score, y = '{v}' AS hit FROM t" for v, c in PROBS.items()) + """),
    g AS (SELECT label, score, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM o GROUP BY ALL),
    w AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY label ORDER BY score DESC) AS fp,
      sum(pos) OVER (PARTITION BY label) AS p, sum(neg) OVER (PARTITION BY label) AS n FROM g),
    a AS (SELECT label, sum(neg * (tp - pos / 2)) / (CAST(any_value(p) AS DOUBLE) * any_value(n)) AS auc, any_value(p) AS support, sum(pos / p * (tp / (tp + fp))) AS ap FROM w GROUP BY label)"""


@query("roc_auc_per_class", G + f", {_OVR} SELECT label, {r('auc')} AS auc FROM a")
def _(t):
    return e.roc_auc(guesses(t), "y", PROBS).select("label", rounded(F.col("auc")).alias("auc"))


@query("roc_auc_macro_weighted", G + f", {_OVR} SELECT {r('avg(auc)')} AS macro_auc, {r('sum(auc * support) / sum(support)')} AS weighted_auc FROM a")
def _(t):
    df = e.average_auc(e.roc_auc(guesses(t), "y", PROBS))
    return df.select(*[rounded(F.col(c)).alias(c) for c in df.columns])


@query("pr_curve", N + f", {_POINTS} SELECT '1' AS label, score, {r('tp / (tp + fp)')} AS precision, {r('tp / p')} AS recall FROM w")
def _(t):
    df = e.pr_curve(binary(t), "y", {1: "score"})
    return df.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall")})


@query("average_precision", N + f", {_POINTS} SELECT '1' AS label, {r('sum(pos / p * (tp / (tp + fp)))')} AS average_precision FROM w")
def _(t):
    return e.average_precision(binary(t), "y", {1: "score"}).select("label", rounded(F.col("average_precision")).alias("average_precision"))


@query("average_precision_macro", G + f", {_OVR} SELECT {r('avg(ap)')} AS macro_ap FROM a")
def _(t):
    return e.average_precision(guesses(t), "y", PROBS).agg(rounded(F.avg("average_precision")).alias("macro_ap"))


@query(
    "regression_metrics",
    P + f"""SELECT {r('avg(abs(y - p))', 4)} AS mae, {r('avg((y - p) * (y - p))', 1)} AS mse, {r('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse,
    {r('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2 FROM t""",
)
def _(t):
    df = e.regression_metrics(prices(t), "y", "p")
    return df.select(rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("mse"), 1).alias("mse"), rounded(F.col("rmse"), 4).alias("rmse"), rounded(F.col("r2")).alias("r2"))


@query("mape", P + f"SELECT {r('avg(abs((y - p) / y)) FILTER (WHERE y <> 0) * 100')} AS mape FROM t")
def _(t):
    return e.regression_metrics(prices(t), "y", "p").select(rounded(F.col("mape")).alias("mape"))


@query("smape", P + f"SELECT {r('avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-8)) * 100')} AS smape FROM t")
def _(t):
    return e.regression_metrics(prices(t), "y", "p").select(rounded(F.col("smape")).alias("smape"))


def _even(k):
    return f"""n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM t),
    s AS (SELECT n.* FROM n JOIN (SELECT DISTINCT i * ((SELECT count(*) FROM t) - 1) // {k - 1} AS place FROM range({k}) x(i)) USING (place))"""


@query(
    "residuals",
    P + f""", {_even(300)}, a AS (SELECT avg(y - p) AS m, stddev_pop(y - p) AS d FROM t)
    SELECT id, y AS actual, p AS predicted, {r('y - p', 4)} AS residual, {r('m', 4)} AS mean_residual, {r('d', 4)} AS std_residual FROM s, a""",
)
def _(t):
    df = e.residuals(prices(t), "y", "p", ["id"])
    return df.withColumns({c: rounded(F.col(c), 4) for c in ("residual", "mean_residual", "std_residual")})


@query("prediction_distribution", G + "SELECT p AS label, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM t GROUP BY p")
def _(t):
    return e.predicted_classes(guesses(t), "p")


@query("prediction_distribution_values", P + f"SELECT {r('avg(p)', 4)} AS mean, {r('stddev_pop(p)', 4)} AS std, min(p) AS min, max(p) AS max FROM t")
def _(t):
    df = e.predicted_values(prices(t), "p")
    return df.withColumns({c: rounded(F.col(c), 4) for c in ("mean", "std")})


@query("prediction_samples", P + f", {_even(50)} SELECT id, y AS actual, p AS predicted, {r('y - p', 4)} AS residual, {r('abs(y - p)', 4)} AS abs_error FROM s")
def _(t):
    df = e.prediction_samples(prices(t), "y", "p", ["id"], "regression")
    return df.withColumns({c: rounded(F.col(c), 4) for c in ("residual", "abs_error")})


@query("prediction_samples_classes", f"WITH t AS (SELECT doc_id AS id, quality AS y, toxic AS p FROM labels), {_even(50)} SELECT id, y AS actual, p AS predicted, y = p AS correct FROM s")
def _(t):
    df = t("labels").withColumnRenamed("doc_id", "id")
    return e.prediction_samples(df, "quality", "toxic", ["id"], "classification")


@query("max_rows_guard", f"WITH t AS (SELECT event_id AS id, value FROM events), {_even(5000)} SELECT id, value FROM s")
def _(t):
    df = t("events").select(F.col("event_id").alias("id"), "value")
    return e.limit_rows(df, ["id"], 5000)


@query("class_distribution", "SELECT event_type AS label, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY event_type")
def _(t):
    return class_share(t("events"), "event_type")


# one evaluation record per supplier: class scores from flags, value scores from prices
RECORDS = """SELECT l_suppkey AS record, CASE WHEN avg(l_discount) < 0.05 THEN 'classification' ELSE 'regression' END AS task_type, count(*) AS test_size,
    round(avg(CASE WHEN l_quantity > 12 THEN 1.0e0 ELSE 0.0e0 END), 4) AS accuracy, round(avg(CASE WHEN l_tax > 0.01 THEN 1.0e0 ELSE 0.0e0 END), 4) AS precision,
    round(avg(CASE WHEN l_discount > 0.02 THEN 1.0e0 ELSE 0.0e0 END), 4) AS recall, round(max(l_tax) * 10, 4) AS f1,
    round(CASE WHEN min(l_quantity) > 1 THEN avg(l_quantity) / 30 END, 4) AS roc_auc, round(avg(l_tax) * 10, 4) AS log_loss,
    count(CASE WHEN l_returnflag = 'A' AND l_quantity > 47 THEN 1 END) AS top_error_count,
    count(CASE WHEN l_quantity > 12 THEN 1 END) AS majority, count(CASE WHEN l_quantity <= 12 THEN 1 END) AS minority,
    round(avg(l_quantity) / 30, 4) AS r2, round(stddev_pop(l_quantity), 4) AS rmse, round(avg(l_quantity) / 2.6, 4) AS mae, round(CASE WHEN max(l_tax) < 0.08 THEN 1.0e0 ELSE avg(l_tax) END, 4) AS mape,
    round(avg(l_discount) - 0.048, 4) AS mean_residual, round(stddev_pop(l_discount), 4) AS std_residual, round(avg(l_quantity) * 2.75, 1) AS top3_share,
    round(avg(l_quantity) / 25, 4) AS train_score, round(avg(l_extendedprice) / 58000, 4) AS validation_score FROM lineitem GROUP BY l_suppkey"""


def _rule(cat, when, sev, title):
    q = lambda x: x if x.startswith("CASE") or x.startswith("'") else f"'{x}'"
    return f"SELECT record, '{cat}' AS category, {q(sev)} AS severity, {q(title)} AS title FROM t WHERE {when}"


_C, _V = "task_type = 'classification'", "task_type = 'regression'"
_RULES = [
    _rule("evaluation", "test_size > 0", "info", "Evaluation basis"),
    _rule("performance", _C, "info", "Strongest and weakest metric"),
    _rule("performance", f"{_C} AND accuracy IS NOT NULL", "CASE WHEN accuracy >= 0.85 THEN 'positive' WHEN accuracy < 0.70 THEN 'warning' ELSE 'info' END",
          "CASE WHEN accuracy >= 0.95 THEN 'Overall correctness: excellent' WHEN accuracy >= 0.85 THEN 'Overall correctness: strong' WHEN accuracy >= 0.70 THEN 'Overall correctness: moderate' ELSE 'Overall correctness: weak' END"),
    _rule("error_pattern", _C, "CASE WHEN abs(precision - recall) < 0.05 THEN 'info' ELSE 'warning' END", "Precision/recall balance"),
    _rule("performance", _C, "info", "Probability calibration"),
    _rule("performance", f"{_C} AND roc_auc IS NULL", "warning", "ROC-AUC unavailable"),
    _rule("error_pattern", _C, "CASE WHEN top_error_count > 0 THEN 'info' ELSE 'positive' END", "CASE WHEN top_error_count > 0 THEN 'Most frequent misclassification' ELSE 'No misclassifications' END"),
    _rule("data", f"{_C} AND (minority = 0 OR majority / minority >= 3)", "CASE WHEN minority > 0 AND majority / minority < 10 THEN 'info' ELSE 'warning' END",
          "CASE WHEN minority > 0 AND majority / minority < 10 THEN 'Moderate class imbalance' ELSE 'Severe class imbalance' END"),
    _rule("performance", _V, "CASE WHEN r2 >= 0.75 THEN 'positive' WHEN r2 < 0.5 THEN 'warning' ELSE 'info' END",
          "CASE WHEN r2 >= 0.90 THEN 'Variance explained: excellent' WHEN r2 >= 0.75 THEN 'Variance explained: strong' WHEN r2 >= 0.5 THEN 'Variance explained: moderate' ELSE 'Variance explained: weak' END"),
    _rule("error_pattern", _V, "CASE WHEN rmse / mae >= 1.5 THEN 'warning' ELSE 'info' END", "CASE WHEN rmse / mae >= 1.5 THEN 'Heavy error tail' ELSE 'Error magnitude' END"),
    _rule("performance", _V, "info", "CASE WHEN mape IS NULL THEN 'MAPE unavailable' ELSE 'Percentage error' END"),
    _rule("error_pattern", f"{_V} AND std_residual > 0 AND abs(mean_residual) > 0.1 * std_residual", "warning", "Systematic bias"),
    _rule("features", "TRUE", "info", "CASE WHEN top3_share >= 70 THEN 'Concentrated features' ELSE 'Dominant features' END"),
    _rule("overfitting", "TRUE", "CASE WHEN train_score - validation_score > 0.10 THEN 'warning' ELSE 'positive' END",
          "CASE WHEN train_score - validation_score > 0.10 THEN 'Possible overfitting' ELSE 'No clear overfitting' END"),
]


@query("evaluation_insights", f"WITH t AS ({RECORDS}) " + "\nUNION ALL ".join(_RULES))
def _(t):
    return e.insights(t.sql(RECORDS, "lineitem"), "record").drop("detail")
