"""Cleaning queries over events with natural gaps, odd codes and a long tail."""

from pyspark.sql import functions as F

from tablewright.operators import clean as c
from tablewright.operators import prep
from tablewright.plans.types import rounded
from tablewright.workload.fragments import SHORT_ITEMS, fences, r
from tablewright.workload.registry import query

MESSY = """
SELECT event_id, ts, user_id, NULLIF(event_type, 'error') AS kind, CASE WHEN value < 150 THEN value END AS amount,
       NULLIF(CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE), 7) AS k,
       CASE WHEN value < 5 THEN NULL WHEN value > 300 THEN 'n/a' ELSE regexp_extract(props, '[0-9]+', 0) END AS code
FROM events
"""
M = f"WITH t AS ({MESSY})"


def messy(t):
    return t.sql(MESSY, "events")


def view(df, *numbers):
    """Key and the columns of interest, doubles rounded."""
    return df.withColumns({n: rounded(F.col(n)) for n in numbers})


FIELDS = ["event_id", "kind", "amount", "k", "code"]
MODE_KIND = "(SELECT kind FROM t WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"


def _numeric_fill(name, amount, k, code):
    sql = M + f"""SELECT event_id, coalesce(kind, {MODE_KIND}) AS kind, {r(f'coalesce(amount, {amount})')} AS amount,
        {r(f'coalesce(k, {k})')} AS k, {r(f'coalesce(TRY_CAST(code AS DOUBLE), {code})')} AS code FROM t"""

    @query(f"impute_{name}", sql)
    def _(t):
        df, _ = c.impute(messy(t), name, ["kind", "amount", "k", "code"])
        return view(df.select(*FIELDS), "amount", "k", "code")


_numeric_fill("mean", "(SELECT avg(amount) FROM t)", "(SELECT avg(k) FROM t)", "(SELECT avg(TRY_CAST(code AS DOUBLE)) FROM t)")
_numeric_fill("median", "(SELECT median(amount) FROM t)", "(SELECT median(k) FROM t)", "(SELECT median(TRY_CAST(code AS DOUBLE)) FROM t)")
_numeric_fill("zero", "0", "0", "0")


def _mode(col):
    return f"(SELECT {col} FROM t WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


@query(
    "impute_mode",
    M + f"""SELECT event_id, coalesce(kind, {_mode('kind')}) AS kind, coalesce(amount, {_mode('amount')}) AS amount,
    coalesce(k, {_mode('k')}) AS k, coalesce(code, {_mode('code')}) AS code FROM t""",
)
def _(t):
    return c.impute(messy(t), "mode", ["kind", "amount", "k", "code"])[0].select(*FIELDS)


@query("impute_constant", M + "SELECT event_id, coalesce(kind, 'other') AS kind, code FROM t")
def _(t):
    return c.impute(messy(t), "constant", ["kind"], value="other")[0].select("event_id", "kind", "code")


@query("impute_unknown", M + "SELECT event_id, coalesce(kind, 'unknown') AS kind, coalesce(code, 'unknown') AS code FROM t")
def _(t):
    return c.impute(messy(t), "unknown", ["kind", "code"])[0].select("event_id", "kind", "code")


def _ordered_fill(method, name, desc):
    over = f"OVER (PARTITION BY user_id ORDER BY ts {desc}, event_id {desc} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = f"OVER (ORDER BY ts {desc}, event_id {desc} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = lambda o: ", ".join(f"last_value({x} IGNORE NULLS) {o} AS {x}" for x in ("kind", "amount", "k"))

    @query(f"impute_{method}", M + f"SELECT event_id, {cols(whole)} FROM t")
    def _(t):
        df, _ = c.impute(messy(t), method, ["kind", "amount", "k"], order_by=["ts", "event_id"])
        return df.select("event_id", "kind", "amount", "k")

    @query(f"fill_{name}", M + f"SELECT event_id, user_id, {cols(over)} FROM t")
    def _(t):
        df, _ = c.impute(messy(t), method, ["kind", "amount", "k"], order_by=["ts", "event_id"], partition_by=["user_id"])
        return df.select("event_id", "user_id", "kind", "amount", "k")


_ordered_fill("ffill", "forward", "")
_ordered_fill("bfill", "backward", "DESC")


@query("impute_stats", M + "SELECT count(*) - count(kind) + count(*) - count(amount) + count(*) - count(k) AS filled FROM t")
def _(t):
    df, _ = c.impute(messy(t), "median", ["kind", "amount", "k"])
    before, after = messy(t), df
    holes = lambda d: d.agg(sum(F.count_if(F.col(x).isNull()) for x in ("kind", "amount", "k")).alias("n"))
    return holes(before).alias("a").join(holes(after).alias("b"), F.col("b.n") == 0).select(F.col("a.n").alias("filled"))


S = f"WITH t AS ({SHORT_ITEMS})"


@query("dedup_rows", S + "SELECT DISTINCT * FROM t")
def _(t):
    return c.dedup(t.sql(SHORT_ITEMS, "lineitem"))[0]


TEXTS = "SELECT doc_id, text, lang FROM documents"


def _dedup_keep(keep, pick):
    @query(f"dedup_keep_{keep}", f"SELECT {pick}(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
    def _(t):
        return c.dedup(t.sql(TEXTS, "documents"), ["doc_id"], keep)[0]


_dedup_keep("first", "min")
_dedup_keep("last", "max")


@query(
    "dedup_subset",
    "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
)
def _(t):
    df = t("events").select("user_id", "event_type", "event_id", "value")
    return c.dedup(df, ["event_id"], "last", ["user_id", "event_type"])[0]


EV = "WITH t AS (SELECT event_id, user_id, value, value * value AS squared FROM events)"
F_V, F_S = fences("t", "value"), fences("t", "squared")


def spread(t):
    return t.sql("SELECT event_id, user_id, value, value * value AS squared FROM events", "events")


@query(
    "outlier_flag",
    EV + f"""SELECT event_id, value < f.lower OR value > f.upper AS value_outlier, squared < s.lower OR squared > s.upper AS squared_outlier
    FROM t, {F_V} f, {F_S} s""",
)
def _(t):
    return c.flag_outliers(spread(t), ["value", "squared"])[0].select("event_id", "value_outlier", "squared_outlier")


@query(
    "outlier_flag_zscore",
    EV + f"SELECT event_id, abs(value - f.mean) / f.std > 2.5 AS value_outlier FROM t, {F_V} f",
)
def _(t):
    return c.flag_outliers(spread(t), ["value"], "zscore", 2.5)[0].select("event_id", "value_outlier")


@query(
    "outlier_remove",
    EV + f"""SELECT event_id, user_id, value FROM t, {F_V} f, {F_S} s
    WHERE NOT (value < f.lower OR value > f.upper OR squared < s.lower OR squared > s.upper)""",
)
def _(t):
    return c.outliers(spread(t), "remove", ["value", "squared"])[0].select("event_id", "user_id", "value")


@query(
    "outlier_cap",
    EV + f"""SELECT event_id, {r('least(greatest(value, f.lower), f.upper)')} AS value,
    {r('least(greatest(squared, s.lower), s.upper)')} AS squared FROM t, {F_V} f, {F_S} s""",
)
def _(t):
    return view(c.outliers(spread(t), "cap", ["value", "squared"])[0].drop("user_id"), "value", "squared")


@query(
    "outlier_cap_zscore",
    EV + f"""SELECT event_id, {r('least(greatest(value, f.mean - 2 * f.std), f.mean + 2 * f.std)')} AS value FROM t, {F_V} f""",
)
def _(t):
    return view(c.outliers(spread(t), "cap", ["value"], "zscore", 2.0)[0].select("event_id", "value"), "value")


@query(
    "outlier_to_median",
    EV + f"""SELECT event_id, {r('CASE WHEN value < f.lower OR value > f.upper THEN f.med ELSE value END')} AS value FROM t, {F_V} f""",
)
def _(t):
    return view(c.outliers(spread(t), "median", ["value"])[0].select("event_id", "value"), "value")


_KINDS = ["click", "purchase", "signup", "view"]


@query(
    "onehot",
    M + "SELECT event_id, " + ", ".join(f"coalesce(kind = '{v}', FALSE) AS kind_{v}" for v in _KINDS) + ", kind IS NULL AS kind_nan FROM t",
)
def _(t):
    return c.one_hot(messy(t).select("event_id", "kind"), ["kind"])[0]


@query("label_encode", M + """, d AS (SELECT kind, CAST(row_number() OVER (ORDER BY kind) - 1 AS INTEGER) AS code FROM t WHERE kind IS NOT NULL GROUP BY kind)
    SELECT event_id, coalesce(d.code, -1) AS kind FROM t LEFT JOIN d USING (kind)""")
def _(t):
    return c.label_encode(messy(t).select("event_id", "kind"), ["kind"])[0]


@query("label_encode_names", """WITH d AS (SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code, p_partkey FROM part)
    SELECT p_partkey, code AS p_name FROM d""")
def _(t):
    return c.label_encode(t("part").select("p_partkey", "p_name"), ["p_name"])[0]


@query("ordinal_encode", M + "SELECT event_id, CAST(CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS DOUBLE) AS kind FROM t")
def _(t):
    return c.ordinal_encode(messy(t).select("event_id", "kind"), ["kind"], {"kind": ["view", "click", "purchase"]})[0]


@query(
    "encode_per_column",
    "SELECT o_orderkey, CAST(ascii(o_orderpriority) - ascii('1') AS INTEGER) AS o_orderpriority, "
    + ", ".join(f"o_orderstatus = '{s}' AS o_orderstatus_{s}" for s in "FOP") + " FROM orders",
)
def _(t):
    df = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return c.encode(df, {"o_orderpriority": "label", "o_orderstatus": "one_hot"})[0]


def _scale(name, centre, width):
    col = lambda x: f"(SELECT ({x} - {centre.format(x=x)}) / {width.format(x=x)})"

    stats = ", ".join(
        f"avg({x}) AS {x}_mean, stddev_samp({x}) AS {x}_std, min({x}) AS {x}_min, max({x}) AS {x}_max, quantile_cont({x}, 0.25) AS {x}_q1, "
        f"quantile_cont({x}, 0.5) AS {x}_med, quantile_cont({x}, 0.75) AS {x}_q3" for x in ("amount", "k"))

    @query(f"scale_{name}", M + f", s AS (SELECT {stats} FROM t) SELECT event_id, {r(col('amount'))} AS amount, {r(col('k'))} AS k FROM t, s")
    def _(t):
        return view(c.scale(messy(t).select("event_id", "amount", "k"), name, ["amount", "k"])[0], "amount", "k")


_scale("standard", "{x}_mean", "{x}_std")
_scale("minmax", "{x}_min", "({x}_max - {x}_min)")
_scale("robust", "{x}_med", "({x}_q3 - {x}_q1)")


@query(
    "batch_clean",
    M + f"""SELECT event_id, {r('coalesce(amount, (SELECT median(amount) FROM t))')} AS amount,
    coalesce(kind = 'purchase', FALSE) AS kind_purchase, coalesce(kind = 'signup', FALSE) AS kind_signup, coalesce(kind = 'view', FALSE) AS kind_view FROM t""",
)
def _(t):
    df = messy(t).select("event_id", "kind", "amount", (F.col("user_id") * 0 + 1).alias("flat"))
    df, _ = c.batch(
        df,
        [
            {"type": "impute_missing", "strategy": "median", "columns": ["amount"]},
            {"type": "encode_categorical", "columns": ["kind"]},
            {"type": "feature_selection", "threshold": 0.01},
        ],
    )
    return view(df, "amount")


_AUTO = f"""WITH t AS (SELECT user_id, NULLIF(event_type, 'error') AS kind, CASE WHEN value < 400 THEN value END AS value FROM events),
    i AS (SELECT DISTINCT user_id, coalesce(kind, {MODE_KIND}) AS kind, coalesce(value, (SELECT median(value) FROM t)) AS value FROM t),
    a AS (SELECT i.* FROM i, {fences('i', 'user_id')} f WHERE NOT (user_id < f.lower OR user_id > f.upper)),
    b AS (SELECT a.* FROM a, {fences('a', 'value')} f WHERE NOT (value < f.lower OR value > f.upper)),
    m AS (SELECT min(user_id) AS u0, max(user_id) AS u1, min(value) AS v0, max(value) AS v1 FROM b)
    SELECT {r('(user_id - u0) / (u1 - u0)')} AS user_id, {r('(value - v0) / (v1 - v0)')} AS value, kind = 'purchase' AS kind_purchase,
    kind = 'signup' AS kind_signup, kind = 'view' AS kind_view FROM b, m"""


@query("auto_clean", _AUTO)
def _(t):
    df = t.sql(
        "SELECT user_id, NULLIF(event_type, 'error') AS kind, CASE WHEN value < 400 THEN value END AS value FROM events", "events"
    )
    return view(c.auto(df)[0], "user_id", "value")


_ENGINE = """SELECT o_orderkey, o_custkey AS customer_id, o_totalprice, NULLIF(o_orderpriority, '5-LOW') AS priority,
    CASE WHEN o_totalprice < 300000 THEN o_totalprice / 1000 END AS price_k, o_orderstatus, 7 AS seven FROM orders"""
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query(
    "engine_clean",
    f"""WITH t AS ({_ENGINE}), k AS (SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    q AS (SELECT quantile_cont(price_k, 0.25) AS a, quantile_cont(price_k, 0.75) AS b, quantile_cont(o_totalprice, 0.25) AS c, quantile_cont(o_totalprice, 0.75) AS d FROM t),
    z AS (SELECT o_orderkey, o_orderstatus, least(greatest(o_totalprice, c - 1.5 * (d - c)), d + 1.5 * (d - c)) AS o_totalprice,
      CASE WHEN price_k IS NOT NULL THEN least(greatest(price_k, a - 1.5 * (b - a)), b + 1.5 * (b - a)) END AS price_k, coalesce(t.priority, k.priority) AS priority FROM t, q, k),
    i AS (SELECT *  REPLACE (coalesce(price_k, (SELECT median(price_k) FROM z)) AS price_k) FROM z),
    s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(price_k) AS m2, stddev_pop(price_k) AS s2 FROM i)
    SELECT o_orderkey, o_orderstatus, {r('(o_totalprice - m1) / s1')} AS o_totalprice, {r('(price_k - m2) / s2')} AS price_k,
    {', '.join(f'''CASE WHEN priority = '{p}' THEN 1e0 ELSE 0e0 END AS "priority_{p}"''' for p in _PRIORITIES)} FROM i, s""",
)
def _(t):
    df, _ = prep.engine_clean(t.sql(_ENGINE, "orders"), "o_orderstatus", keep=["o_orderkey"], outlier=True)
    return view(df, "o_totalprice", "price_k")


@query("impute_unknown_numbers", "SELECT event_id, coalesce(CAST(NULLIF(user_id, 7) AS VARCHAR), 'unknown') AS user_id FROM events")
def _(t):
    df = t("events").select("event_id", F.nullif("user_id", F.lit(7)).alias("user_id"))
    return c.impute(df, "unknown")[0]


@query("impute_constant_text", "SELECT event_id, coalesce(CAST(NULLIF(user_id, 7) AS VARCHAR), 'n/a') AS user_id FROM events")
def _(t):
    df = t("events").select("event_id", F.nullif("user_id", F.lit(7)).alias("user_id"))
    return c.impute(df, "constant", value="n/a")[0]


@query("impute_mode_all_null", "SELECT event_id, 'unknown' AS nothing FROM events")
def _(t):
    df = t("events").select("event_id", F.lit(None).cast("double").alias("nothing"))
    return c.impute(df, "mode", ["nothing"])[0]


@query("ordinal_many", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS DOUBLE) AS o_custkey FROM orders")
def _(t):
    return c.ordinal_encode(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"])[0]
