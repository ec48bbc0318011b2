"""Filters, joins, aggregates, sorting, set operations: what users write as SQL."""

from pyspark.sql import functions as F

from tablewright.operators import clean, relational as rel
from tablewright.operators.profile import unbiased_skewness
from tablewright.plans.selection import quantiles
from tablewright.plans.types import numeric_columns, rounded
from tablewright.plans.wide import unpivot_stats
from tablewright.workload.fragments import ITEMS, SHORT_ITEMS, per_column, r, union
from tablewright.workload.registry import query


def plain(name, sql, *tables):
    """A query whose SQL text is the same for both engines."""

    @query(name, sql)
    def _(t):
        return t.sql(sql, *tables)


# --- filters ----------------------------------------------------------------------------------------

plain(
    "sql_select",
    """SELECT c_mktsegment, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_acctbal > 0 GROUP BY c_mktsegment, n_name""",
    "customer", "nation",
)


@query(
    "filter_compare",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')
    AND NOT l_linestatus = 'O' AND (l_discount < 0.03 OR l_discount > 0.07) AND l_shipdate IS NOT NULL""",
)
def _(t):
    c = F.col
    kept = (
        c("l_quantity").between(10, 20)
        & c("l_returnflag").isin("A", "R")
        & ~(c("l_linestatus") == "O")
        & ((c("l_discount") < 0.03) | (c("l_discount") > 0.07))
        & c("l_shipdate").isNotNull()
    )
    return t("lineitem").where(kept).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("filter_ilike", "SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%the%AND%'")
def _(t):
    return t("documents").where(rel.contains_terms(F.col("text"), "the", "AND")).select("doc_id", "lang", "source")


@query("filter_above_avg", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def _(t):
    return rel.above_average(t("orders"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("filter_recent_days", "SELECT event_id, event_type FROM events WHERE ts >= DATE '2024-01-31' - INTERVAL 7 DAY")
def _(t):
    return rel.recent_days(t("events"), "ts", "2024-01-31", 7).select("event_id", "event_type")


@query("null_counts", f"WITH t AS ({ITEMS})" + per_column(["quantity", "price", "discount", "tax", "flag", "status", "line"], lambda c: f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM t"))
def _(t):
    df = t.sql(ITEMS, "lineitem")
    return unpivot_stats(df, df.columns, {"nulls": lambda c: F.count_if(F.col(c).isNull())})


@query(
    "history_search",
    """WITH m AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%high%')
    SELECT o_orderkey, o_orderpriority, o_totalprice, (SELECT count(*) FROM m) AS total FROM m ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""",
)
def _(t):
    df = rel.history_page(
        t("orders"), "o_orderkey", " HIGH ", ["o_orderpriority"], {"o_orderstatus": "F"}, "o_totalprice",
        ["o_orderdate", "o_totalprice"], offset=100,
    )
    return df.select("o_orderkey", "o_orderpriority", "o_totalprice", "total")


_SEARCHED = {
    "customer": ("c_custkey", ["c_name", "c_mktsegment"]),
    "part": ("p_partkey", ["p_name", "p_brand"]),
    "supplier": ("s_suppkey", ["s_name"]),
    "orders": ("o_orderkey", ["o_orderpriority"]),
    "documents": ("doc_id", ["lang", "text"]),
    "events": ("event_id", ["event_type"]),
}


@query(
    "global_search",
    union(
        f"""(SELECT '{n}' AS entity, CAST({k} AS VARCHAR) AS id, CAST({cs[0]} AS VARCHAR) AS title FROM {n}
        WHERE {' OR '.join(f"{c} ILIKE '%er%'" for c in cs)} ORDER BY {k} LIMIT 10)"""
        for n, (k, cs) in _SEARCHED.items()
    ),
)
def _(t):
    return rel.global_search({n: (t(n), k, cs) for n, (k, cs) in _SEARCHED.items()}, "er")


@query("drop_id_columns", "SELECT event_type, value FROM events")
def _(t):
    return clean.drop_ids(t("events").drop("ts", "props"))


_CONST = "SELECT event_id, value, 3 AS three, CASE WHEN value > 10000 THEN 1.5e0 END AS never, event_type FROM events"


@query("drop_constant_columns", "SELECT event_id, value, event_type FROM events")
def _(t):
    return clean.drop_constants(t.sql(_CONST, "events"))


@query("drop_high_cardinality", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    return clean.drop_high_cardinality(t("documents"))


_TOKENS = "SELECT doc_id, text AS text_hash, lang, source FROM documents"


@query(
    "drop_high_cardinality_prep",
    "SELECT doc_id, lang, source FROM documents",
)
def _(t):
    return clean.drop_high_cardinality(t.sql(_TOKENS, "documents"), rule="prep")


_FLAT = "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_discount * 0.01e0 AS tiny FROM lineitem"


@query("drop_low_variance", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    return clean.drop_low_variance(t.sql(_FLAT, "lineitem"), 0.01)[0]


@query("drop_null_target", "SELECT event_id, NULLIF(event_type, 'error') AS label FROM events WHERE event_type <> 'error'")
def _(t):
    df = t.sql("SELECT event_id, NULLIF(event_type, 'error') AS label FROM events", "events")
    return df.where(F.col("label").isNotNull())


@query(
    "grid_filter_sort",
    """SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
    WHERE (CAST(p_partkey AS VARCHAR) || ' ' || p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size) ILIKE '%small%' AND p_brand ILIKE '%#1%'""",
)
def _(t):
    df = t("part").drop("p_retailprice")
    return rel.grid(df, "SMALL", {"p_brand": "#1"}, [("p_size", True), ("p_name", False)])


@query("align_columns", "SELECT o_totalprice, 0e0 AS discount, o_custkey FROM orders")
def _(t):
    return rel.align_columns(t("orders"), ["o_totalprice", "discount", "o_custkey"], missing="zero")[0]


# --- joins ------------------------------------------------------------------------------------------


@query(
    "join_inner",
    f"""SELECT n_name, o_orderstatus, count(*) AS n, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def _(t):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "o_orderstatus")
        .agg(F.count("*").alias("n"), rounded(revenue, 2).alias("revenue"))
    )


@query(
    "join_left",
    """SELECT c_custkey, count(o_orderkey) AS orders, count(o_orderkey) FILTER (WHERE o_totalprice > 300000) AS large FROM customer
    LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY ALL""",
)
def _(t):
    o = t("orders").where(F.col("o_orderstatus") == "F").groupBy("o_custkey")
    o = o.agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 300000).alias("large"))
    joined = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "large")])


for _how in ("right", "full"):
    plain(
        f"join_{_how}",
        f"""SELECT d.doc_id AS doc_id, l.doc_id AS labelled, l.quality AS quality, d.lang AS lang FROM (SELECT * FROM documents WHERE n_chars > 1000) d
        {_how.upper()} JOIN labels l ON d.doc_id = l.doc_id""",
        "documents", "labels",
    )


_BANDS = "SELECT o_orderpriority AS band, min(o_totalprice) AS low, avg(o_totalprice) AS high FROM orders GROUP BY o_orderpriority"


@query(
    "join_cross_theta",
    f"WITH b AS ({_BANDS}) SELECT band, count(*) AS n, {r('sum(c_acctbal)', 2)} AS balance FROM customer JOIN b ON c_acctbal * 50 BETWEEN low AND high GROUP BY band",
)
def _(t):
    bands = t.sql(_BANDS, "orders")  # one row per priority
    inside = (F.col("c_acctbal") * 50).between(F.col("low"), F.col("high"))
    return t("customer").join(F.broadcast(bands), inside).groupBy("band").agg(F.count("*").alias("n"), rounded(F.sum("c_acctbal"), 2).alias("balance"))


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def _(t):
    big = t("orders").where(F.col("o_totalprice") > 450000)
    return t("customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def _(t):
    big = t("orders").where(F.col("o_totalprice") > 450000)
    return t("customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


_DATASETS = """SELECT p_partkey AS id, p_name AS filename, CASE WHEN p_size > 5 THEN CAST(p_size AS BIGINT) END AS owner_id,
    CASE WHEN p_type = 'PROMO' THEN 'sample' ELSE 'upload' END AS source FROM part"""
_SHARES = """SELECT l_partkey AS dataset_id, CASE WHEN l_returnflag = 'A' THEN l_suppkey END AS shared_with_user_id,
    CASE WHEN l_returnflag = 'R' THEN s_name END AS shared_with_email FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


@query(
    "visible_datasets",
    f"""WITH d AS ({_DATASETS}), s AS ({_SHARES}) SELECT * FROM d WHERE owner_id IS NULL OR owner_id = 7 OR source = 'sample'
    OR EXISTS (SELECT 1 FROM s WHERE dataset_id = d.id AND (shared_with_user_id = 7 OR lower(shared_with_email) = 'supplier#000000007'))""",
)
def _(t):
    return rel.visible_datasets(t.sql(_DATASETS, "part"), t.sql(_SHARES, "lineitem", "supplier"), 7, "Supplier#000000007")


_FILES = "SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20)), '.pkl') AS name, p_retailprice AS size_kb FROM part WHERE p_size > 15"
_REGISTRY = """SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_type = 'PROMO' THEN '.pkl' ELSE '' END) AS name,
    CASE WHEN p_size > 40 THEN 'production' WHEN p_size > 30 THEN 'archived' WHEN p_size > 20 THEN 'staging' END AS status FROM part WHERE p_retailprice > 950"""


@query(
    "registry_reconcile",
    f"""WITH f AS ({_FILES}), g AS (SELECT *, CASE WHEN name LIKE '%.pkl' THEN name ELSE name || '.pkl' END AS as_file FROM ({_REGISTRY}))
    SELECT coalesce(f.name, g.name) AS name, CASE WHEN g.name IS NULL OR (coalesce(g.status, '') IN ('', 'staging') AND f.name IS NOT NULL) THEN 'ready' ELSE g.status END AS status,
    g.name IS NOT NULL AS registered, f.name IS NOT NULL AS has_file, size_kb FROM f FULL JOIN g ON f.name = g.as_file""",
)
def _(t):
    return rel.reconcile_registry(t.sql(_FILES, "part"), t.sql(_REGISTRY, "part"))


@query(
    "project_counts",
    """SELECT c_custkey, coalesce(a.n, 0) AS experiments, coalesce(b.n, 0) AS datasets, coalesce(c.n, 0) AS models FROM customer
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a ON a.k = c_custkey
    LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON b.k = c_custkey
    LEFT JOIN (SELECT conv_id AS k, count(*) AS n FROM conversations GROUP BY 1) c ON c.k = c_custkey""",
)
def _(t):
    parts = {"experiments": (t("orders"), "o_custkey"), "datasets": (t("events"), "user_id"), "models": (t("conversations"), "conv_id")}
    return rel.project_counts(t("customer").select("c_custkey"), "c_custkey", parts)


_A = "SELECT l_partkey AS feature, round(avg(l_discount) - 0.05e0, 6) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey"
_B = "SELECT l_partkey AS feature, round(avg(l_tax) - 0.04e0, 6) AS value FROM lineitem WHERE l_quantity > 25 GROUP BY l_partkey"


@query(
    "merge_explanations",
    f"""WITH a AS ({_A}), b AS ({_B}), m AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.value, 0) AS first_value, coalesce(b.value, 0) AS second_value
    FROM a FULL JOIN b ON a.feature = b.feature) SELECT *, CASE WHEN first_value < 0 THEN 'negative' ELSE 'positive' END AS first_direction,
    CASE WHEN second_value < 0 THEN 'negative' ELSE 'positive' END AS second_direction FROM m""",
)
def _(t):
    return rel.merge_explanations(t.sql(_A, "lineitem"), t.sql(_B, "lineitem"))


# --- aggregates -------------------------------------------------------------------------------------


@query("agg_count", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def _(t):
    return t("lineitem").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_avg_min_max", f"SELECT {r('avg(l_extendedprice)', 8)} AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def _(t):
    c = "l_extendedprice"
    return t("lineitem").agg(rounded(F.avg(c), 8).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"))


@query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("group_avg", f"SELECT p_brand, {r('avg(p_retailprice)', 8)} AS mean, count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    return t("part").groupBy("p_brand").agg(rounded(F.avg("p_retailprice"), 8).alias("mean"), F.count("*").alias("n")).orderBy(F.desc("mean"))


@query("group_sum", f"SELECT l_suppkey, {r('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(rounded(F.sum("l_extendedprice"), 2).alias("total"))


@query("group_summary", f"SELECT c_mktsegment, count(*) AS n, {r('avg(c_acctbal)', 8)} AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment")
def _(t):
    c = "c_acctbal"
    return t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), rounded(F.avg(c), 8).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"))


@query("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where(F.col("n") > 10)


_FIVE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("rounded_avg_sum", per_column(_FIVE, lambda c: f"SELECT '{c}' AS column_name, {r(f'avg({c})', 2)} AS mean, {r(f'sum({c})', 2)} AS total FROM lineitem"))
def _(t):
    return unpivot_stats(t("lineitem"), _FIVE, {"mean": lambda c: rounded(F.avg(c), 2), "total": lambda c: rounded(F.sum(c), 2)})


@query("agg_stddev", per_column(_FIVE, lambda c: f"SELECT '{c}' AS column_name, {r(f'avg({c})', 8)} AS mean, {r(f'stddev({c})', 8)} AS std, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM lineitem"))
def _(t):
    stats = {
        "mean": lambda c: rounded(F.avg(c), 8),
        "std": lambda c: rounded(F.stddev(c), 8),
        "low": lambda c: F.min(c).cast("double"),
        "high": lambda c: F.max(c).cast("double"),
    }
    return unpivot_stats(t("lineitem"), _FIVE, stats)


_SETS = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY "
plain("grouping_sets", _SETS + "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "lineitem")


@query("agg_cube", _SETS + "CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("agg_rollup", _SETS + "ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


_Q = {"l_quantity": "lineitem", "l_extendedprice": "lineitem", "l_discount": "lineitem"}


@query("agg_quantiles", per_column(_Q, lambda c: f"SELECT '{c}' AS column_name, {r(f'quantile_cont({c}, 0.25)')} AS q1, {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q3 FROM lineitem"))
def _(t):
    got = quantiles(t("lineitem"), {c: (F.col(c), [0.25, 0.5, 0.75]) for c in _Q})
    df = t.spark.createDataFrame([(c, *v) for c, v in got.items()], "column_name string, q1 double, median double, q3 double")
    return df.withColumns({c: rounded(F.col(c)) for c in ("q1", "median", "q3")})


@query("agg_mode", per_column(["l_quantity", "l_suppkey", "l_linenumber"], lambda c: f"(SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"))
def _(t):
    from tablewright.plans.counts import modes

    got = modes(t("lineitem"), ["l_quantity", "l_suppkey", "l_linenumber"])
    return t.spark.createDataFrame([(c, float(v)) for c, v in got.items()], "column_name string, value double")


@query("agg_skewness", per_column(["value", "user_id"], lambda c: f"SELECT '{c}' AS column_name, {r(f'skewness({c})', 5)} AS skewness FROM events"))
def _(t):
    return unpivot_stats(t("events"), ["value", "user_id"], {"skewness": lambda c: rounded(unbiased_skewness(F.col(c)), 5)})


# --- sorting, paging, sampling ----------------------------------------------------------------------


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("bottom_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(10)


@query(
    "page_result",
    """SELECT event_id, event_type, value, (SELECT count(*) FROM events) AS total, FALSE AS truncated FROM events ORDER BY event_id LIMIT 50 OFFSET 150""",
)
def _(t):
    return rel.page(t("events").select("event_id", "event_type", "value"), ["event_id"], 3, 50)


@query(
    "page_result_deep",
    """SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS total, FALSE AS truncated FROM
    (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem) WHERE p > 5500 AND p <= 11000""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return rel.page(t("lineitem").select(*keys), keys, 1, 5500).drop("l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "sample_evenly",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events),
    w AS (SELECT DISTINCT i * (n - 1) // 299 AS p FROM range(300) x(i), (SELECT count(*) AS n FROM events)) SELECT event_id, value FROM n JOIN w USING (p)""",
)
def _(t):
    return rel.sample_evenly(t("events"), ["ts", "event_id"], 300).select("event_id", "value")


@query(
    "sample_rows",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY substr(md5('42|' || o_orderkey), 1, 13), o_orderkey) AS place, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_totalprice FROM r WHERE place <= least(50000, n // 10)""",
)
def _(t):
    n = t("orders").count()
    return rel.sample_rows(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], min(50_000, n // 10))


@query("sort_nulls_last", "SELECT quantity, discount, flag, count(*) AS n FROM (" + SHORT_ITEMS + ") GROUP BY ALL ORDER BY flag NULLS LAST, discount DESC NULLS LAST")
def _(t):
    grouped = t.sql(SHORT_ITEMS, "lineitem").groupBy("quantity", "discount", "flag").agg(F.count("*").alias("n"))
    return grouped.orderBy(F.asc_nulls_last("flag"), F.desc_nulls_last("discount"))


# --- set operations ---------------------------------------------------------------------------------

plain("set_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")


@query("union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def _(t):
    a = t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("set_intersect", "SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer")
def _(t):
    return t("events").select("user_id").intersect(t("customer").select("c_custkey"))


@query("set_except", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    pairs = lambda flag: t("lineitem").where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey")
    return pairs("A").exceptAll(pairs("R"))


@query("distinct_rows", "SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM lineitem")
def _(t):
    return t("lineitem").select("l_quantity", "l_discount", "l_returnflag").distinct()


plain(
    "cte_query",
    """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey),
    ranked AS (SELECT c_mktsegment, o_custkey, total, n FROM spend JOIN customer ON o_custkey = c_custkey)
    SELECT c_mktsegment, count(*) AS customers, round(max(total), 2) AS best, CAST(sum(n) AS BIGINT) AS orders FROM ranked
    WHERE total > (SELECT avg(total) FROM spend) GROUP BY c_mktsegment""",
    "orders", "customer",
)
