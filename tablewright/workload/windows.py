"""Window queries."""

from pyspark.sql import functions as F

from tablewright.operators import series as s
from tablewright.plans.types import rounded
from tablewright.workload.fragments import r
from tablewright.workload.registry import query


@query("win_rank", "SELECT event_id, rank() OVER (ORDER BY value DESC) AS rank, dense_rank() OVER (ORDER BY value DESC) AS dense_rank FROM events")
def _(t):
    return s.ranks(t("events").select("event_id", "value"), "value").select("event_id", "rank", "dense_rank")


@query("win_rank_lines", "SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_quantity DESC) AS rank, dense_rank() OVER (ORDER BY l_quantity DESC) AS dense_rank FROM lineitem")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return s.ranks(df, "l_quantity").drop("l_quantity")


@query("win_row_number", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders")
def _(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return s.row_numbers(df, ["o_orderdate", "o_orderkey"], partition_by=["o_custkey"]).drop("o_orderdate")


@query("win_ntile", "SELECT o_orderkey, CAST(ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS decile FROM orders")
def _(t):
    return s.ntiles(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 10, "decile").drop("o_totalprice")


@query(
    "win_lead_lag_first_last",
    """SELECT event_id, user_id, lag(value) OVER w AS previous, lead(value) OVER w AS next, first_value(value) OVER w AS first_value,
    last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t):
    df = t("events").select("event_id", "user_id", "ts", "value")
    return s.neighbours(df, "value", ["ts", "event_id"], ["user_id"]).drop("ts", "value")


_LAGS = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in s.LAGS)


@query("lag_features", f"SELECT event_id, {_LAGS} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return s.lag_features(t("events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", *[f"lag_{k}" for k in s.LAGS])


def _rolled(n, stat, end=0):
    over = f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1 - end} PRECEDING AND {'CURRENT ROW' if end == 0 else '1 PRECEDING'})"
    return f"CASE WHEN count(value) {over} = {n} THEN {r(f'{stat}(value) {over}')} END"


def _rolling_sql(end):
    return f"SELECT event_id, {_rolled(3, 'avg', end)} AS rolling_mean_3, {_rolled(7, 'avg', end)} AS rolling_mean_7, {_rolled(3, 'stddev_samp', end)} AS rolling_std_3 FROM events"


ROLLED = ["rolling_mean_3", "rolling_mean_7", "rolling_std_3"]


@query("rolling_features", _rolling_sql(0))
def _(t):
    df = s.rolling_features(t("events"), "value", ["ts", "event_id"], ["user_id"])
    return df.select("event_id", *[rounded(F.col(c)).alias(c) for c in ROLLED])


@query("rolling_features_past", _rolling_sql(-1))
def _(t):
    df = s.rolling_features(t("events"), "value", ["ts", "event_id"], ["user_id"], exclude_current=True)
    return df.select("event_id", *[rounded(F.col(c)).alias(c) for c in ROLLED])


@query(
    "series_features",
    f"""SELECT * FROM (SELECT event_id, lag(value, 7) OVER w AS lag_7, {_rolled(7, 'avg')} AS rolling_mean_7 FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE lag_7 IS NOT NULL""",
)
def _(t):
    df = s.series_features(t("events"), "value", ["ts", "event_id"], ["user_id"])
    return df.select("event_id", "lag_7", rounded(F.col("rolling_mean_7")).alias("rolling_mean_7"))


@query(
    "week_over_week",
    """WITH a AS (SELECT DATE '2024-01-30' - CAST(ts AS DATE) AS age FROM events), c AS (SELECT count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS this_week,
    count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS last_week FROM a) SELECT *, round((this_week - last_week) * 100.0 / last_week, 1) AS change_pct FROM c""",
)
def _(t):
    return s.week_over_week(t("events"), "ts", "2024-01-30")
