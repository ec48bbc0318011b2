"""Target and task detection queries."""

from tablewright.operators import detection as d
from tablewright.workload.fragments import SHORT_COLUMNS, SHORT_ITEMS, SHORT_NUMBERS, per_column, r, union
from tablewright.workload.registry import query

# columns of the training table, whether they are numeric, and hints in their names
LOANS = """SELECT o_orderkey AS loan_id, o_custkey AS customer, o_totalprice AS price, o_orderpriority AS priority,
    CAST(length(o_orderpriority) AS INTEGER) AS grade, o_orderstatus AS status FROM orders"""
COLUMNS = {"loan_id": True, "customer": True, "price": True, "priority": False, "grade": True, "status": False}
L = f"WITH t AS ({LOANS}), u AS (" + union(
    f"SELECT '{c}' AS column_name, {i} AS position, {num} AS num, count(DISTINCT {c}) AS u, count({c}) AS n FROM t"
    for i, (c, num) in enumerate(COLUMNS.items())
) + ")"


def loans(t):
    return t.sql(LOANS, "orders")


def _hints(names, exact=False):
    return "(" + " + ".join(f"CAST(contains(column_name, '{h}') AS INTEGER)" for h in names) + ")"


def _placed(scores, limit):
    return f"""p AS (SELECT column_name, CAST(position AS INTEGER) AS position, {r('score', 2)} AS score, u AS unique_values,
    CAST(row_number() OVER (ORDER BY round(score, 2) DESC, position) AS INTEGER) AS place FROM {scores})
    SELECT * FROM p WHERE place <= {limit}"""


def _capped(hints):
    # every matching hint adds 2, never beyond 10
    return f"least(10, score + 2 * {_hints(hints)})"


@query(
    "target_scores_ratio",
    L + f""", s AS (SELECT *, round(CASE WHEN u / n <= 0.05 AND u <= 30 THEN 10 - 10.0 * u / n WHEN num AND u <= 20 THEN 10 - 10.0 * u / n
    WHEN NOT num AND u <= 30 THEN 8 - 8.0 * u / n ELSE 0 END, 2) AS score FROM u WHERE n >= 2),
    h AS (SELECT * REPLACE ({_capped(d.RATIO_HINTS)} AS score) FROM s WHERE score > 0), {_placed('h', 5)}""",
)
def _(t):
    return d.target_scores(loans(t), "ratio")


@query(
    "target_scores_engine",
    L + f""", s AS (SELECT *, CASE WHEN u / n <= 0.05 AND u <= 30 THEN 10 - 10.0 * u / n WHEN num AND u <= 20 THEN 9 - 5.0 * u / n
    WHEN NOT num AND u <= 30 THEN 8 - 5.0 * u / n WHEN num THEN 4 ELSE 0 END AS score FROM u WHERE n >= 2),
    h AS (SELECT * REPLACE ({_capped(d.ENGINE_HINTS)} AS score) FROM s WHERE score > 0), {_placed('h', 6)}""",
)
def _(t):
    return d.target_scores(loans(t), "engine")


@query(
    "detect_target_scores",
    L + f""", i AS (SELECT *, (column_name LIKE '%id') AS looks_id FROM u),
    s AS (SELECT *, CASE WHEN looks_id OR (u / n >= 0.9 AND NOT num) THEN -100 ELSE 0 END
      + CASE WHEN column_name IN ({', '.join(f"'{h}'" for h in d.EVALUATION_HINTS)}) THEN 60 WHEN {_hints(d.EVALUATION_HINTS)} > 0 THEN 35 ELSE 0 END
      + CASE WHEN position = 5 AND NOT looks_id THEN 20 ELSE 0 END
      + CASE WHEN u BETWEEN 2 AND 20 THEN 25 WHEN u > 20 AND num AND NOT looks_id THEN 15 ELSE 0 END AS score FROM i),
    z AS (SELECT column_name, CAST(position AS INTEGER) AS position, {r('score', 2)} AS score, u AS unique_values,
      CAST(row_number() OVER (ORDER BY score DESC, position) AS INTEGER) AS place FROM s)
    SELECT *, CASE WHEN score >= 40 THEN 'High' WHEN score >= 15 THEN 'Medium' ELSE 'Low' END AS confidence FROM z""",
)
def _(t):
    return d.target_scores(loans(t), "evaluation")


@query(
    "detect_target_by_name",
    L + f""", s AS (SELECT *, CAST({_hints(d.NAME_ONLY_HINTS)} > 0 AS INTEGER) + CASE WHEN position = 5 THEN 0.5 ELSE 0 END AS score FROM u), {_placed('s', 10)}""",
)
def _(t):
    return d.target_scores(loans(t), "name")


_KINDS = {"event_id": True, "user_id": True, "event_type": False, "value": True, "k": True, "day": True}
_EVENTS = """SELECT event_id, user_id, event_type, value, CAST(floor(value / 20) AS INTEGER) AS k,
    CAST(day(ts) AS INTEGER) AS day FROM events"""


@query(
    "detect_task_type",
    f"""WITH t AS ({_EVENTS}), u AS ({union(f"SELECT '{c}' AS column_name, {num} AS num, count(DISTINCT {c}) AS u, count(*) AS n, {f'bool_and({c} % 1 = 0)' if num else 'FALSE'} AS whole FROM t" for c, num in _KINDS.items())}),
    c AS (SELECT *, NOT num OR (whole AND u <= 20) AS a, NOT num OR (whole AND (u <= 20 OR (u <= 50 AND u / n <= 0.05))) AS b FROM u)
    SELECT column_name, u AS unique_values, CASE WHEN a THEN 'classification' ELSE 'regression' END AS training,
    CASE WHEN b THEN 'classification' ELSE 'regression' END AS evaluation, CASE WHEN a THEN 'classification' ELSE 'regression' END AS recommendation,
    num AND whole AND u > 15 AND u <= 30 AS ambiguous FROM c""",
)
def _(t):
    return d.task_types(t.sql(_EVENTS, "events"))


def _analysis(source, column, task, folds):
    classes = task == "classification"
    safe = f"greatest(2, least({folds}, {'min_class_count' if classes else 10}))"
    blocked = "min_class_count < 2" if classes else "FALSE"
    return f"""WITH c AS (SELECT {column} AS v, count(*) AS n FROM {source} GROUP BY 1),
    a AS (SELECT CAST(sum(n) AS BIGINT) AS total_samples, CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing_count, count(v) AS n_classes,
      coalesce(min(n) FILTER (WHERE v IS NOT NULL), 0) AS min_class_count, coalesce(max(n) FILTER (WHERE v IS NOT NULL), 0) AS max_class_count FROM c)
    SELECT '{column}' AS target_column, '{task}' AS task_type, *, n_classes > 50 AND n_classes / total_samples > 0.5 AS high_cardinality,
    n_classes >= 2 AND n_classes / total_samples >= 0.9 AS identifier_like, {blocked} AS blocked,
    CAST(CASE WHEN {blocked} THEN {folds} ELSE {safe} END AS INTEGER) AS safe_folds,
    NOT ({blocked}) AND {safe} < {min(folds, 10) if classes else folds} AS folds_adjusted FROM a"""


@query("analyze_target", _analysis("documents", "source", "classification", 7))
def _(t):
    return d.analyze_target(t("documents"), "source", folds=7)


@query("analyze_target_text", _analysis("documents", "text", "classification", 5))
def _(t):
    return d.analyze_target(t("documents"), "text")


@query("analyze_target_regression", _analysis("orders", "o_totalprice", "regression", 12))
def _(t):
    return d.analyze_target(t("orders"), "o_totalprice", folds=12)


_RULES = {
    "enough_rows": "count(*) >= 5",
    "enough_columns": "count(*) >= 0",
    "enough_known_targets": "count({c}) >= 4",
    "target_varies": "count(DISTINCT {c}) > 1",
    "whole_classes": "NOT bool_or({c} % 1 <> 0)",
    "few_classes": "NOT (count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) / count({c}) > 0.5)",
}


@query("validate_target", union(f"SELECT '{k}' AS \"check\", {v.format(c='value')} AS passed FROM events" for k, v in _RULES.items()))
def _(t):
    return d.validate_target(t("events"), "value", "classification")


_REGRESSION = {
    "enough_rows": "count(*) >= 5",
    "enough_columns": "count(*) >= 0",
    "enough_known_targets": "count(source) >= 4",
    "target_varies": "count(DISTINCT source) > 1",
    "numeric_target": "count(source) - count(TRY_CAST(source AS DOUBLE)) <= 0.2 * count(source)",
    "target_spread": "coalesce(stddev_samp(TRY_CAST(source AS DOUBLE)), 0) > 0",
}


@query("validate_target_regression", union(f"SELECT '{k}' AS \"check\", {v} AS passed FROM documents" for k, v in _REGRESSION.items()))
def _(t):
    return d.validate_target(t("documents"), "source", "regression")


_S = f"WITH t AS (SELECT *, 1 AS one FROM ({SHORT_ITEMS}))"
_COLS = [*SHORT_COLUMNS, "one"]


@query(
    "dataset_recommendations",
    _S + f""", m AS ({per_column(_COLS, lambda c: f"SELECT '{c}' AS c, count(*) - count({c}) AS m, count(DISTINCT {c}) AS u, count(*) AS n FROM t")}),
    k AS (SELECT count(*) AS n FROM t WHERE flag IS NOT NULL GROUP BY flag)
    SELECT 'missing_values' AS issue, CASE WHEN max(m * 100.0 / n) > 30 THEN 'high' ELSE 'medium' END AS severity, count(*) AS concerned FROM m WHERE m > 0
    UNION ALL SELECT 'null_target', 'high', m FROM m WHERE c = 'flag' AND m > 0
    UNION ALL SELECT 'duplicate_rows', 'low', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) FROM t
    UNION ALL SELECT 'class_imbalance', 'medium', count(*) FROM k HAVING max(n) / min(n) > 3 AND count(*) > 1
    UNION ALL SELECT 'constant_features', 'medium', count(*) FROM m WHERE u <= 1 AND c <> 'flag' HAVING count(*) > 0
    UNION ALL SELECT CASE WHEN count(*) * {len(_COLS)} < 20000 THEN 'size_small' WHEN count(*) * {len(_COLS)} < 200000 THEN 'size_medium' ELSE 'size_large' END,
      'info', count(*) * {len(_COLS)} FROM t""",
)
def _(t):
    t("lineitem").createOrReplaceTempView("lineitem")
    return d.dataset_recommendations(t.spark.sql(f"SELECT *, 1 AS one FROM ({SHORT_ITEMS})"), "flag")


_REMOVE = """SELECT event_id, value, CASE WHEN value > 80 THEN value END AS gap, CASE WHEN value > 250 THEN 0.001 ELSE 0.0 END AS flat,
    user_id AS index_user FROM events"""


@query(
    "feature_removal_advice",
    f"""WITH t AS ({_REMOVE}), u AS ({per_column(['event_id', 'value', 'gap', 'flat', 'index_user'], lambda c: f"SELECT '{c}' AS column_name, 1 - count({c}) / count(*) AS m, stddev_samp({c}) AS s FROM t")})
    SELECT column_name, 'high_missing' AS reason FROM u WHERE m > 0.5
    UNION ALL SELECT column_name, 'low_variance' FROM u WHERE s > 0 AND s < 0.01
    UNION ALL SELECT column_name, 'identifier' FROM u WHERE regexp_matches(column_name, '^(id|index|_id|row_num|serial)')""",
)
def _(t):
    df = t.sql(_REMOVE, "events")
    return d.removal_advice(df.withColumn("flat", df["flat"].cast("double")))
