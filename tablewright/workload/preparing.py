"""Split, fold and preparation queries."""

from pyspark.sql import functions as F

from tablewright.operators import prep as p
from tablewright.plans.types import rounded
from tablewright.plans.wide import unpivot_stats
from tablewright.workload.fragments import r
from tablewright.workload.registry import query


def place(key):
    return f"substr(md5('42|' || {key}), 1, 13)"


@query(
    "split_random",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {place('o_orderkey')}, o_orderkey) <= ceil(count(*) OVER () * 0.2) AS is_test FROM orders""",
)
def _(t):
    return p.split_random(t("orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query(
    "split_stratified",
    f"""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {place('event_id')}, event_id)
    <= floor(0.2 * count(*) OVER (PARTITION BY event_type) + 0.5) AS is_test FROM events""",
)
def _(t):
    return p.split_stratified(t("events"), ["event_id"], "event_type").select("event_id", "event_type", "is_test")


@query("split_temporal", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) > floor(0.8 * count(*) OVER ()) AS is_test FROM events")
def _(t):
    return p.split_temporal(t("events"), ["ts", "event_id"]).select("event_id", "is_test")


@query("split_temporal_ties", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > floor(0.8 * count(*) OVER ()) AS is_test FROM orders")
def _(t):
    return p.split_temporal(t("orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_test")


def _fold(rn, n, k):
    big = f"(({n}) % {k}) * (({n}) // {k} + 1)"
    return f"CAST(CASE WHEN {rn} - 1 < {big} THEN ({rn} - 1) // (({n}) // {k} + 1) ELSE ({n}) % {k} + ({rn} - 1 - {big}) // (({n}) // {k}) END AS INTEGER)"


@query(
    "fold_assign",
    f"""WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {place('event_id')}, event_id) AS rn,
    count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, {_fold('rn', 'n', 5)} AS fold FROM n""",
)
def _(t):
    return p.assign_folds(t("events"), ["event_id"], 5, "event_type").select("event_id", "event_type", "fold")


@query(
    "fold_assign_plain",
    f"WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY {place('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {_fold('rn', 'n', 7)} AS fold FROM n",
)
def _(t):
    return p.assign_folds(t("orders"), ["o_orderkey"], 7).select("o_orderkey", "fold")


_BY_USER = f"""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY {place('event_id')}, event_id) AS rn FROM events"""


@query("split_by_user", f"SELECT event_id, user_id, rn <= least(greatest(floor(0.2 * n + 0.5), 1), n - 1) AS is_test FROM ({_BY_USER})")
def _(t):
    return p.split_stratified(t("events").select("event_id", "user_id"), ["event_id"], "user_id")


@query(
    "fold_by_user",
    f"WITH n AS ({_BY_USER}), f AS (SELECT greatest(2, least(5, min(n))) AS k FROM n) SELECT event_id, user_id, {_fold('rn', 'n', 'k')} AS fold FROM n, f",
)
def _(t):
    return p.assign_folds(t("events").select("event_id", "user_id"), ["event_id"], 5, "user_id")


TRAINING = """SELECT event_id, CASE WHEN value < 150 THEN value END AS amount, NULLIF(event_type, 'error') AS kind,
    CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k, user_id > 75 AS late, ts FROM events"""
_KINDS = ["click", "purchase", "signup", "view"]


@query(
    "prep_fit_transform",
    f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY {place('event_id')}, event_id) <= ceil(count(*) OVER () * 0.2) AS is_test FROM ({TRAINING})),
    a AS (SELECT median(amount) AS amount_fill, median(k) AS k_fill FROM t WHERE NOT is_test),
    m AS (SELECT kind AS kind_fill FROM t WHERE NOT is_test AND kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
    f AS (SELECT event_id, is_test, coalesce(amount, amount_fill) AS amount, coalesce(k, k_fill) AS k, CAST(CAST(late AS INTEGER) AS DOUBLE) AS late,
      coalesce(kind, kind_fill) AS kind FROM t, a, m),
    s AS (SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(k) AS mk, stddev_pop(k) AS sk, avg(late) AS ml, stddev_pop(late) AS sl FROM f WHERE NOT is_test)
    SELECT event_id, is_test, {r('(amount - ma) / sa')} AS amount, {r('(k - mk) / sk')} AS k, {r('(late - ml) / CASE WHEN sl > 0 THEN sl ELSE 1 END')} AS late,
    {', '.join(f"CASE WHEN kind = '{v}' THEN 1e0 ELSE 0e0 END AS kind_{v}" for v in _KINDS)} FROM f, s""",
)
def _(t):
    df = p.split_random(t.sql(TRAINING, "events"), ["event_id"])
    fitted = p.fit_preparation(df.where(~F.col("is_test")), ["amount", "k", "late", "kind"])
    out = fitted.transform(df, ["event_id", "is_test"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("amount", "k", "late")})


@query(
    "prep_dates",
    f"""WITH s AS (SELECT avg(epoch_us(ts) / 1e6) AS m, stddev_pop(epoch_us(ts) / 1e6) AS d FROM events)
    SELECT event_id, {r('(epoch_us(ts) / 1e6 - m) / d')} AS ts FROM events, s""",
)
def _(t):
    df = t("events").select("event_id", "ts")
    out = p.fit_preparation(df, ["ts"]).transform(df, ["event_id"])
    return out.withColumn("ts", rounded(F.col("ts")))


@query(
    "target_label_map",
    "SELECT source AS label, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM documents GROUP BY source",
)
def _(t):
    return p.label_map(t("documents"), "source")


_MIXED = """SELECT o_orderkey, o_orderpriority AS truth, CASE WHEN o_totalprice > 250000 THEN CAST(ascii(o_orderpriority) - ascii('1') AS VARCHAR(3)) ELSE o_orderpriority END AS predicted FROM orders"""


@query("reconcile_labels", "SELECT o_orderkey, CAST(ascii(o_orderpriority) - ascii('1') AS INTEGER) AS truth, CAST(ascii(o_orderpriority) - ascii('1') AS INTEGER) AS predicted FROM orders")
def _(t):
    df = t.sql(_MIXED, "orders")
    mapping = p.label_map(df, "truth")
    return p.reconcile_labels(p.reconcile_labels(df, "truth", mapping), "predicted", mapping)


@query(
    "class_weights",
    f"""SELECT doc_id, lang, {r('(SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * CAST(count(*) OVER (PARTITION BY lang) AS DOUBLE))')} AS weight FROM documents""",
)
def _(t):
    df = p.class_weights(t("documents").select("doc_id", "lang"), "lang")
    return df.withColumn("weight", rounded(F.col("weight")))


@query("pca_95")
def _(t):
    e = t("embeddings")
    n = len(e.first()["embedding"])
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])
    out, _ = p.pca_share(wide, [f"e{i}" for i in range(n)], ["vec_id"])
    return out.withColumns({c: rounded(F.col(c)) for c in out.columns if c != "vec_id"})


@query(
    "prep_high_cardinality",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY concat('c', o_custkey)) AS BIGINT) AS place FROM orders",
)
def _(t):
    df = t("orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"))
    found = p.fit_preparation(df, ["customer"], drop_id_text=False).vectors(df, ["o_orderkey"])
    return found.select("o_orderkey", p.first_place(F.col("features"), 1.0).alias("place"))
