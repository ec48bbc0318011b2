"""Dashboard and streaming queries: orders stand in for runs, events for logs, parts and documents for datasets."""

from pyspark.sql import functions as F

from tablewright.operators import dashboards as d
from tablewright.plans.types import rounded
from tablewright.streaming import daily
from tablewright.workload.fragments import r
from tablewright.workload.registry import query

ANCHOR = "2024-01-31"


@query("daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS cnt FROM events WHERE ts >= DATE '2024-01-31' - INTERVAL 14 DAY GROUP BY 1")
def _(t):
    return d.daily_counts(t("events"), "ts", ANCHOR, 14)


@query("usage_top10", "SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS cnt FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return d.usage_top(t("events"), "user_id")


@query("type_distribution", "SELECT coalesce(NULLIF(event_type, 'error'), 'unknown') AS name, count(*) AS cnt FROM events GROUP BY 1")
def _(t):
    return d.type_distribution(t.sql("SELECT NULLIF(event_type, 'error') AS kind FROM events", "events"), "kind")


RUNS = """SELECT o_orderkey AS run, o_custkey AS dataset, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'queued' END AS status,
    o_totalprice / 1000 AS training_time, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS score, o_orderdate AS created_at FROM orders"""
DATASETS = "SELECT doc_id, n_chars / 1e3 AS size_kb, n_chars AS rows FROM documents"
LOGS = "SELECT event_id, user_id, value AS latency_ms, ts AS created_at, event_type FROM events"


@query(
    "platform_totals",
    f"""WITH a AS ({RUNS}), b AS ({DATASETS}), c AS (SELECT * FROM ({LOGS}) WHERE created_at >= DATE '2024-01-31' - INTERVAL 10 DAY)
    SELECT (SELECT count(*) FROM a) AS total_runs, (SELECT round(sum(training_time) / 3600, 2) FROM a) AS training_hours,
    (SELECT round(count(*) FILTER (WHERE status = 'success') * 100.0 / count(*), 1) FROM a) AS success_rate, (SELECT count(*) FROM b) AS total_datasets,
    (SELECT round(sum(size_kb) / 1024, 2) FROM b) AS storage_mb, (SELECT CAST(sum(rows) AS BIGINT) FROM b) AS dataset_rows, (SELECT count(*) FROM c) AS total_predictions,
    (SELECT round(sum(latency_ms) / count(*), 1) FROM c) AS avg_latency_ms, (SELECT count(DISTINCT user_id) FROM c) AS active_sessions""",
)
def _(t):
    logs = t.sql(LOGS, "events")
    datasets = t.sql(DATASETS, "documents").withColumn("size_kb", F.col("size_kb").cast("double"))
    return d.platform_totals(t.sql(RUNS, "orders"), datasets, logs, logs, ANCHOR, 10)


@query("score_trend", f"SELECT strftime(created_at, '%Y-%m-%d') AS date, {r('score * 100', 2)} AS score FROM ({RUNS}) WHERE score IS NOT NULL")
def _(t):
    df = d.score_trend(t.sql(RUNS, "orders"), "created_at", "score")
    return df.withColumn("score", rounded(F.col("score"), 2))


AUDIT = """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id AS VARCHAR(20)) END AS user_id,
    concat('  User ', CAST(user_id AS VARCHAR(20)), ' ') AS actor, event_type AS action FROM events"""


@query("activity_for_user", f"SELECT * FROM ({AUDIT}) WHERE lower(coalesce(user_id, '')) = '17' OR (user_id IS NULL AND lower(trim(actor)) IN ('17', 'user 17'))")
def _(t):
    return d.activity_for_user(t.sql(AUDIT, "events"), "17", "User 17 ")


@query(
    "admin_counts",
    """SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FILTER (WHERE c_acctbal > 0) FROM customer) AS active_users,
    (SELECT count(*) FROM supplier) AS teams, (SELECT count(*) FROM orders) AS runs, (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders) AS finished_runs,
    (SELECT count(*) FROM documents) AS datasets, (SELECT count(*) FROM part) AS models, (SELECT count(*) FROM events) AS predictions,
    (SELECT count(*) FILTER (WHERE event_type = 'error') FROM events) AS errors""",
)
def _(t):
    return d.counts_in_one_row(
        {
            "users": (t("customer"), None),
            "active_users": (t("customer"), F.col("c_acctbal") > 0),
            "teams": (t("supplier"), None),
            "runs": (t("orders"), None),
            "finished_runs": (t("orders"), F.col("o_orderstatus") == "F"),
            "datasets": (t("documents"), None),
            "models": (t("part"), None),
            "predictions": (t("events"), None),
            "errors": (t("events"), F.col("event_type") == "error"),
        }
    )


@query(
    "experiment_summary",
    f"""WITH a AS (SELECT * FROM ({RUNS}) WHERE score IS NOT NULL), k AS (SELECT dataset, run, score, CAST(row_number() OVER (PARTITION BY dataset ORDER BY score DESC, run) AS INTEGER) AS place,
    count(*) OVER (PARTITION BY dataset) AS runs, max(score) OVER (PARTITION BY dataset) - min(score) OVER (PARTITION BY dataset) AS spread, avg(score) OVER (PARTITION BY dataset) AS mean FROM a)
    SELECT dataset, run, score, place, runs, {r('spread', 8)} AS spread, {r('mean', 8)} AS mean FROM k WHERE place <= 8""",
)
def _(t):
    df = d.run_summary(t.sql(RUNS, "orders"), "dataset", "score", "run")
    return df.withColumns({c: rounded(F.col(c), 8) for c in ("spread", "mean")})


MODELS = """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Production' WHEN p_size < 30 THEN 'staging' WHEN p_size < 40 THEN 'archived' END AS status,
    CASE WHEN p_size > 5 THEN p_retailprice / 2000 END AS score FROM part"""


@query(
    "registry_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE lower(status) = 'production') AS production, count(*) FILTER (WHERE status = 'staging') AS staging,
    count(*) FILTER (WHERE status = 'archived') AS archived, round(avg(score) * 100, 1) AS avg_accuracy FROM ({MODELS})""",
)
def _(t):
    return d.registry_stats(t.sql(MODELS, "part"))


STATES = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status FROM orders"


@query(
    "run_status_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'running') AS active, round(count(*) FILTER (WHERE status = 'completed') * 100.0 / count(*) FILTER (WHERE status <> 'running'), 1) AS success_rate FROM ({STATES})""",
)
def _(t):
    return d.run_status(t.sql(STATES, "orders"))


UPLOADS = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS status, ts AS created_at, user_id AS rows FROM events"


@query(
    "dataset_status_counts",
    f"""SELECT count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status <> 'ready') AS attention,
    count(*) FILTER (WHERE created_at >= DATE '2024-01-31' - INTERVAL 7 DAY) AS new_this_week, CAST(sum(rows) AS BIGINT) AS total_rows FROM ({UPLOADS})""",
)
def _(t):
    return d.dataset_status(t.sql(UPLOADS, "events"), ANCHOR)


HISTORY = """SELECT concat('SELECT ', event_type, ' FROM user_', CAST(user_id AS VARCHAR(20))) AS query, CASE WHEN value > 200 THEN 'error' ELSE 'success' END AS status,
    value AS duration_ms, event_id AS rows FROM events"""


@query(
    "query_history_stats",
    f"""SELECT query, count(*) AS runs, count(*) FILTER (WHERE status <> 'success') AS failures, {r('avg(duration_ms)', 8)} AS avg_ms, max(duration_ms) AS max_ms,
    CAST(sum(rows) AS BIGINT) AS rows FROM ({HISTORY}) GROUP BY query""",
)
def _(t):
    df = d.query_history(t.sql(HISTORY, "events"), "query")
    return df.withColumn("avg_ms", rounded(F.col("avg_ms"), 8))


TEXTS = """SELECT event_id, concat(CASE event_type WHEN 'view' THEN 'SELECT * FROM t -- DROP TABLE t' WHEN 'click' THEN 'INSERT INTO t VALUES (1); DELETE FROM u'
    WHEN 'error' THEN '/* copy
    */ SELECT replace(a, 1, 2) FROM read_csv(x)' WHEN 'signup' THEN 'UPDATE t SET a = 1 # load' ELSE 'CREATE OR REPLACE TABLE t AS SELECT 1' END, ' ', props,
    CASE WHEN user_id > 100 THEN ' ATTACH db' ELSE '' END) AS text FROM events"""
_CLEAN = "lower(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '(--|#)[^\\n]*', ' ', 'g'))"
_OPS = ", ".join(f"CASE WHEN regexp_matches(c, '{p}') THEN '{n}' END" for n, p in d.DESTRUCTIVE.items())


@query(
    "sql_log_flags",
    f"""WITH t AS (SELECT event_id, {_CLEAN} AS c FROM ({TEXTS})) SELECT event_id, regexp_matches(c, '{"|".join(d.DISALLOWED)}') AS disallowed,
    concat_ws(',', {_OPS}) AS operations FROM t""",
)
def _(t):
    df = d.sql_flags(t.sql(TEXTS, "events"), "text")
    return df.select("event_id", "disallowed", F.concat_ws(",", "operations").alias("operations"))


@query("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS date, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def _(t):
    log = daily.stream_log(t.spark, t.folder, t("events").schema, "events.parquet")
    return daily.run_to_end(daily.daily_windows(log, "ts", "event_type"), "daily")
