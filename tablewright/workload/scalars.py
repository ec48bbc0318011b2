"""Scalar function queries."""

from pyspark.sql import functions as F

from tablewright.functions import scalar as s
from tablewright.plans.types import rounded
from tablewright.workload.fragments import r
from tablewright.workload.registry import query

_ESC = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _ESC = f"replace({_ESC}, '{_a}', '{_b}')"


@query("text_sanitize", f"SELECT page_id, substr({_ESC}, 1, 2000) AS text FROM pages")
def _(t):
    return t("pages").select("page_id", s.sanitize_text(F.col("html")).alias("text"))


@query(
    "name_sanitize",
    """SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_\\s\\-''.@]', '', 'g'), 1, 100) AS name,
    substr(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 255) AS file_name FROM pages""",
)
def _(t):
    url = F.col("url")
    return t("pages").select("page_id", s.sanitize_name(url).alias("name"), s.sanitize_file_name(url).alias("file_name"))


@query("short_repr", "SELECT doc_id, CASE WHEN length(text) > 24 THEN substr(text, 1, 23) || '…' ELSE text END AS short FROM documents")
def _(t):
    return t("documents").select("doc_id", s.short_repr(F.col("text")).alias("short"))


@query(
    "to_number_coerce",
    "SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'none' ELSE CAST(user_id AS VARCHAR) || '.5' END AS DOUBLE) AS number FROM events",
)
def _(t):
    text = F.when(F.col("event_type") == "error", "none").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return t("events").select("event_id", s.to_number(text).alias("number"))


@query(
    "datetime_coerce_epoch",
    f"""SELECT event_id, {r('epoch_us(ts) / 1e6')} AS seconds,
    CASE WHEN event_type = 'error' THEN NULL ELSE {r('epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP))')} END AS day_seconds FROM events""",
)
def _(t):
    text = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    df = t("events").withColumn("text", text)
    return df.select(
        "event_id",
        rounded(s.epoch_seconds(F.col("ts"))).alias("seconds"),
        rounded(s.text_epoch_seconds(F.col("text"))).alias("day_seconds"),
    )


@query(
    "date_parts",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(quarter(ts) AS INTEGER) AS q,
    CAST(day(ts) AS INTEGER) AS d, CAST(dayofweek(ts) AS INTEGER) AS dow FROM events""",
)
def _(t):
    ts = F.col("ts")
    return t("events").select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.quarter(ts).alias("q"), F.day(ts).alias("d"), s.weekday(ts).alias("dow")
    )


@query(
    "month_trunc_group",
    f"SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, count(*) AS n, {r('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1",
)
def _(t):
    month = F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("month")
    return t("lineitem").groupBy(month).agg(F.count("*").alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("total"))


@query("bool_to_double", "SELECT event_id, CAST(CAST(value > 100 AS INTEGER) AS DOUBLE) AS high FROM events")
def _(t):
    return t("events").select("event_id", s.bool_to_double(F.col("value") > 100).alias("high"))


@query("clip", "SELECT event_id, least(greatest(NULLIF(value, 50), 10), 200) + CAST(0 AS DOUBLE) * NULLIF(value, 50) AS value FROM events")
def _(t):
    from tablewright.operators.clean import clip

    value = F.nullif(F.col("value"), F.lit(50.0))
    return t("events").select("event_id", clip(value, F.lit(10.0), F.lit(200.0)).alias("value"))


_CASE = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'normal' ELSE 'single' END AS size,
    coalesce(NULLIF(l_discount, 0), -1) AS discount, NULLIF(l_returnflag, 'N') AS flag, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem"""


@query("case_coalesce_nullif", _CASE)
def _(t):
    return t.sql(_CASE, "lineitem")


@query(
    "json_fields",
    "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL",
)
def _(t):
    k = F.from_json("props", "k bigint")["k"]
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("nested_to_json")
def _(t):
    return s.nested_to_json(t("embeddings"))
