"""Feature engineering queries."""

from pyspark.sql import functions as F

from tablewright.operators import features as f
from tablewright.plans.types import rounded
from tablewright.workload.fragments import r
from tablewright.workload.registry import query

BASE = "SELECT event_id, user_id, CASE WHEN value < 200 THEN value END AS amount, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) - 20 AS k FROM events"
B = f"WITH b AS ({BASE}), t AS (SELECT event_id, user_id, coalesce(amount, (SELECT median(amount) FROM b)) AS amount, k FROM b)"


def made(t, *operations):
    df, _ = f.engineer(t.sql(BASE, "events"), list(operations))
    return df


@query(
    "poly_features",
    B + f"""SELECT event_id, {r('amount * amount')} AS "amount^2", {r('amount * k')} AS "amount k", {r('k * k')} AS "k^2",
    {r('amount * amount * amount')} AS "amount^3", {r('amount * amount * k')} AS "amount^2 k", {r('amount * k * k')} AS "amount k^2", {r('k * k * k')} AS "k^3" FROM t""",
)
def _(t):
    df = made(t, {"type": "polynomial", "columns": ["amount", "k"], "degree": 3})
    new = ["amount^2", "amount k", "k^2", "amount^3", "amount^2 k", "amount k^2", "k^3"]
    return df.select("event_id", *[rounded(F.col(f"`{c}`")).alias(c) for c in new])


@query("poly_features_single", B + f'SELECT event_id, k, {r("k * k", 4)} AS "k^2", {r("k * k * k", 4)} AS "k^3" FROM t')
def _(t):
    df = made(t, {"type": "polynomial", "columns": "k", "degree": 3})
    return df.select("event_id", "k", *[rounded(F.col(f"`{c}`"), 4).alias(c) for c in ("k^2", "k^3")])


@query("interactions", B + f"SELECT event_id, {r('user_id * amount', 4)} AS user_id_x_amount, user_id * k AS user_id_x_k, {r('amount * k', 4)} AS amount_x_k FROM t")
def _(t):
    df = made(t, {"type": "interaction", "columns": ["user_id", "amount", "k"]})
    return df.select("event_id", rounded(F.col("user_id_x_amount"), 4).alias("user_id_x_amount"), "user_id_x_k", rounded(F.col("amount_x_k"), 4).alias("amount_x_k"))


@query(
    "bin_equal_width",
    B + """, s AS (SELECT min(amount) AS lo, (max(amount) - min(amount)) / 5 AS w FROM t)
    SELECT event_id, CAST(greatest(0, least(4, ceil((amount - lo) / w) - 1)) AS INTEGER) AS amount_binned FROM t, s""",
)
def _(t):
    return made(t, {"type": "bin", "columns": ["amount"], "n_bins": 5}).select("event_id", "amount_binned")


@query("log1p_shifted", B + f"SELECT event_id, {r('ln(1 + amount)')} AS log_amount, {r('ln(1 + k - (SELECT min(k) FROM t) + 1)')} AS log_k FROM t")
def _(t):
    df = made(t, {"type": "log", "columns": ["amount", "k"]})
    return df.select("event_id", rounded(F.col("log_amount")).alias("log_amount"), rounded(F.col("log_k")).alias("log_k"))


@query("sqrt_feature", B + f"SELECT event_id, {r('sqrt(amount)')} AS sqrt_amount FROM t")
def _(t):
    df = made(t, {"type": "sqrt", "columns": ["amount", "k"]})
    return df.select("event_id", *[rounded(F.col(c)).alias(c) for c in df.columns if c.startswith("sqrt_")])


_SUGGEST = "SELECT l_quantity, l_discount, l_extendedprice, l_tax, l_returnflag FROM lineitem"


@query(
    "suggest_features",
    """SELECT 'polynomial' AS type, 'l_quantity,l_discount,l_extendedprice' AS columns UNION ALL SELECT 'interaction', 'l_quantity,l_discount,l_extendedprice'
    UNION ALL SELECT 'log', 'l_quantity' FROM lineitem HAVING min(l_quantity) > 0 UNION ALL SELECT 'sqrt', 'l_quantity' FROM lineitem HAVING min(l_quantity) >= 0
    UNION ALL SELECT 'bin', 'l_quantity' UNION ALL SELECT 'log', 'l_discount' FROM lineitem HAVING min(l_discount) > 0
    UNION ALL SELECT 'sqrt', 'l_discount' FROM lineitem HAVING min(l_discount) >= 0 UNION ALL SELECT 'bin', 'l_discount'""",
)
def _(t):
    return f.suggest(t.sql(_SUGGEST, "lineitem"))


@query("ratio_feature", B + f"SELECT event_id, CASE WHEN k <> 0 THEN {r('amount / k', 10)} END AS amount_per_k FROM t")
def _(t):
    df = made(t, {"type": "ratio", "columns": ["amount", "k"]})
    return df.select("event_id", rounded(F.col("amount_per_k"), 10).alias("amount_per_k"))


@query(
    "quantile_bins",
    B + """, q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.5) AS b, quantile_cont(amount, 0.75) AS c FROM t)
    SELECT event_id, CAST(amount > a AS INTEGER) + CAST(amount > b AS INTEGER) + CAST(amount > c AS INTEGER) AS amount_qbin FROM t, q""",
)
def _(t):
    return made(t, {"type": "quantile_bin", "columns": ["amount"]}).select("event_id", "amount_qbin")
