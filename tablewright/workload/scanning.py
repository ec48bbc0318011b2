"""Sources and sinks: each table is written in the format under test and read back."""

from pyspark.sql import functions as F

from tablewright.operators import clean
from tablewright.plans.durable import scratch_path
from tablewright.sources import files as f
from tablewright.sources import versions as v
from tablewright.workload.fragments import fences, union
from tablewright.workload.registry import query

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("scan_csv", CUSTOMER)
def _(t):
    path = scratch_path(t.spark, "customer") + ".csv"
    # a blank after every separator, as hand-made files have it
    padded = t("customer").select(*[F.concat(F.lit(" "), F.col(c).cast("string")).alias(f" {c}") for c in t("customer").columns])
    padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    df = f.load(t.spark, path)
    return df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("scan_tsv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(t):
    path = scratch_path(t.spark, "part") + ".tsv"
    t("part").write.option("header", True).option("sep", "\t").csv(path)
    return f.load(t.spark, path)


@query("scan_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(t):
    path = scratch_path(t.spark, "events") + ".json"
    df = t("events").select("event_id", "user_id", "event_type", "value", "props")
    df.write.json(path)
    return f.load(t.spark, path, df.schema)


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(t):
    df = f.load(t.spark, t.path("orders"))
    kept = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return df.where(kept).select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_csv_permissive", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT o_orderkey, o_orderpriority, 1, o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "rows")
    good = t("supplier").unionByName(
        t("orders").select(
            F.col("o_orderkey").alias("s_suppkey"),
            F.col("o_orderpriority").alias("s_name"),
            F.lit(1).alias("s_nationkey"),
            F.col("o_totalprice").alias("s_acctbal"),
        )
    )
    # suppliers in debt are written with text where a number belongs
    broken = f.columns_as_text(good).withColumn("s_nationkey", F.when(F.col("s_acctbal").cast("double") < 0, "??").otherwise(F.col("s_nationkey")))
    broken.write.option("header", True).csv(path)
    return f.read_csv(t.spark, path, good.schema, skip_malformed=True)


@query("register_views", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    f.register_views({"2024 orders.parquet": t("orders"), "line-items.csv": t("lineitem")}, selected="2024 orders.parquet")
    return t.spark.sql(
        "SELECT d.o_orderstatus, count(*) AS n FROM data d LEFT SEMI JOIN t_2024_orders o ON d.o_orderkey = o.o_orderkey GROUP BY d.o_orderstatus"
    )


_LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


@query(
    "describe_table",
    union(f"SELECT {i} AS position, '{c}' AS column_name, '{k}' AS dtype, TRUE AS nullable, count({c}) AS known FROM lineitem" for i, (c, k) in enumerate(_LINEITEM.items())),
)
def _(t):
    # the schema next to what the column really holds, so that the work follows the table
    from tablewright.plans.wide import unpivot_stats

    df = t("lineitem")
    filled = unpivot_stats(df, df.columns, {"known": lambda c: F.count(c)})
    return f.describe(df).join(F.broadcast(filled), "column_name")


_SIZES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query("dataset_catalog", union(f"SELECT '{n}' AS dataset, count(*) AS rows, CAST({k} AS BIGINT) AS columns FROM {n}" for n, k in _SIZES.items()))
def _(t):
    return f.catalog({n: t(n) for n in _SIZES}).drop("dtypes")


@query(
    "preview_page",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(NULLIF(event_type, 'view'), '') AS kind, CAST(user_id AS VARCHAR) AS user_id
    FROM events ORDER BY events.event_id LIMIT 50 OFFSET 200""",
)
def _(t):
    df = t("events").select("event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"), "user_id")
    return f.preview(df, ["event_id"], offset=200, limit=50)


@query("export_dataset", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(t):
    df = t("orders").drop("o_orderdate")
    return f.read_csv(t.spark, f.export(df, scratch_path(t.spark, "export"), "csv"), df.schema)


@query("export_dataset_parquet", "SELECT * FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(t):
    df = t("supplier").union(t("customer").drop("c_mktsegment"))
    return t.spark.read.parquet(f.export(df, scratch_path(t.spark, "export"), "parquet"))


@query("export_query", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    df = t.sql("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type", "events")
    return t.spark.read.schema(df.schema).json(f.export_result(df, scratch_path(t.spark, "export"), "json")["path"])


@query("export_query_all", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return t.spark.read.schema(df.schema).json(f.export_result(df, scratch_path(t.spark, "export"), "json")["path"])


@query("export_query_first", "SELECT event_id, value FROM events ORDER BY event_id LIMIT (SELECT count(*) // 3 FROM events)")
def _(t):
    df = t("events").select("event_id", "value")
    done = f.export_result(df, scratch_path(t.spark, "export"), "json", df.count() // 3, ["event_id"])
    return t.spark.read.schema(df.schema).json(done["path"])


@query("export_query_nested", "SELECT user_id, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    df = t("events").groupBy("user_id").agg(F.struct(F.count("*").alias("n")).alias("nested"))
    back = f.read_csv(t.spark, f.export_result(df, scratch_path(t.spark, "export"), "csv")["path"])
    return back.select(F.col("user_id").cast("bigint"), F.get_json_object("nested", "$.n").cast("bigint").alias("n"))


@query("result_to_dataset", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    df = t.sql("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type", "events")
    return f.result_to_dataset(df, scratch_path(t.spark, "dataset"))


@query(
    "versioned_write",
    """SELECT CAST(2 AS BIGINT) AS version, count(*) AS rows, count(*) FILTER (WHERE kind IS NULL) AS missing FROM
    (SELECT coalesce(NULLIF(event_type, 'error'), 'unknown') AS kind FROM events)""",
)
def _(t):
    folder = scratch_path(t.spark, "versions")
    before = t.sql("SELECT event_id, NULLIF(event_type, 'error') AS kind FROM events", "events")
    after, stats = clean.impute(before, "unknown", ["kind"])
    n = v.write_version(before, after, stats, folder, "events")
    again, stats = clean.impute(after, "unknown", ["kind"])
    if v.write_version(after, again, stats, folder, "events") is not None:
        raise AssertionError("an unchanged table got a new version")
    written = v.read_version(t.spark, folder, "events")
    return written.agg(
        F.lit(n).cast("bigint").alias("version"), F.count("*").alias("rows"), F.count_if(F.col("kind").isNull()).alias("missing")
    )


NAMES = """SELECT concat(CASE WHEN p_type = 'PROMO' THEN 'cleaned_' WHEN p_type = 'STANDARD' THEN 'featurized_' ELSE '' END,
    replace(p_name, ' ', '_'), CASE WHEN p_size < 10 THEN '_cleaned' ELSE '' END,
    CASE WHEN p_size > 20 THEN concat('_v', CAST(p_size AS VARCHAR(10))) ELSE '' END, '.csv') AS name FROM part"""


@query(
    "dataset_lineage",
    f"""WITH n AS ({NAMES}), b AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.\\w+$', ''), '_v\\d+$', ''),
      '^(cleaned_|featurized_)', '', 'i'), '_(cleaned|featurized)$', '', 'i') AS base,
      CAST(coalesce(NULLIF(regexp_extract(name, '_v(\\d+)(\\.\\w+)?$', 1), ''), '1') AS INTEGER) AS version FROM n)
    SELECT base, count(*) AS versions, max(version) AS active_version, arg_max(name, (version, name)) AS active FROM b GROUP BY base""",
)
def _(t):
    return v.lineage(t.sql(NAMES, "part"))


@query(
    "cleaning_history",
    f"""SELECT 'events' AS base, 2 AS version, 'missing' AS stage, 'mode' AS method, count(*) AS rows_affected FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'events', 3, 'outliers', 'iqr', count(*) FROM events, {fences('events', 'value')} f WHERE value < f.lower OR value > f.upper""",
)
def _(t):
    folder = scratch_path(t.spark, "versions")
    before = t.sql("SELECT event_id, user_id, NULLIF(event_type, 'error') AS kind, value FROM events", "events")
    filled, s1 = clean.impute(before, "mode", ["kind"])
    v.log_step(t.spark, folder, "events", 2, "missing", "mode", ["kind"], s1)
    capped, s2 = clean.outliers(filled, "cap", ["value"])
    v.log_step(t.spark, folder, "events", 3, "outliers", "iqr", ["value"], s2)
    return v.history(t.spark, folder, "events").drop("columns", "details")
