"""Dashboards over log tables: runs, predictions, audits, queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.plans.types import quoted


def since(df: DataFrame, ts: str, anchor: str, days: int) -> DataFrame:
    return df.where(quoted(ts) >= F.lit(anchor).cast("date") - F.expr(f"INTERVAL {days} DAYS"))


def daily_counts(df: DataFrame, ts: str, anchor: str, days: int = 30) -> DataFrame:
    """Rows per day of the last ``days`` days."""
    day = F.date_format(quoted(ts), "yyyy-MM-dd").alias("date")
    return since(df, ts, anchor, days).groupBy(day).agg(F.count("*").alias("cnt")).orderBy("date")


def usage_top(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most used values; ties by name."""
    counts = df.groupBy(F.coalesce(quoted(column).cast("string"), F.lit("unknown")).alias("name")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "name").limit(n)


def type_distribution(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.coalesce(quoted(column).cast("string"), F.lit("unknown")).alias("name")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "name")


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row results next to each other."""
    one = first.withColumn("_one", F.lit(1))
    for other in others:
        one = one.join(F.broadcast(other.withColumn("_one", F.lit(1))), "_one")
    return one.drop("_one")


def platform_totals(
    runs: DataFrame, datasets: DataFrame, predictions: DataFrame, sessions: DataFrame, anchor: str, days: int = 30
) -> DataFrame:
    """Totals, training hours, megabytes, success rate, latency and active sessions in one row.

    Expected columns: runs (status, training_time), datasets (size_kb, rows), predictions and sessions (created_at, latency_ms / user_id).
    """
    share = F.count_if(F.col("status") == "success") / F.greatest(F.count("*"), F.lit(1)) * 100
    a = runs.agg(
        F.count("*").alias("total_runs"),
        F.round(F.coalesce(F.sum("training_time"), F.lit(0)) / 3600, 2).alias("training_hours"),
        F.round(share, 1).alias("success_rate"),
    )
    b = datasets.agg(
        F.count("*").alias("total_datasets"),
        F.round(F.coalesce(F.sum("size_kb"), F.lit(0)) / 1024, 2).alias("storage_mb"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("dataset_rows"),
    )
    recent = since(predictions, "created_at", anchor, days)
    latency = F.sum(F.coalesce("latency_ms", F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1))
    c = recent.agg(F.count("*").alias("total_predictions"), F.coalesce(F.round(latency, 1), F.lit(0.0)).alias("avg_latency_ms"))
    d = since(sessions, "created_at", anchor, days).agg(F.count_distinct("user_id").alias("active_sessions"))
    return beside(a, b, c, d)


def score_trend(df: DataFrame, ts: str, score: str) -> DataFrame:
    """Date and score in percent of every run that has one."""
    day = F.coalesce(F.date_format(quoted(ts), "yyyy-MM-dd"), F.lit("unknown"))
    return df.where(quoted(score).isNotNull()).select(day.alias("date"), (quoted(score) * 100).alias("score"))


def activity_for_user(df: DataFrame, user_id: str, name: str) -> DataFrame:
    """The user's own rows, and rows without a user whose actor is the user's id or name."""
    uid = user_id.lower()
    owner = F.lower(F.coalesce(quoted("user_id").cast("string"), F.lit("")))
    actor = F.lower(F.trim(F.coalesce(quoted("actor"), F.lit(""))))
    return df.where((owner == uid) | ((owner == "") & actor.isin(uid, name.strip().lower())))


def counts_in_one_row(tables: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One count per (table, condition), all in one row."""
    parts = [
        df.agg((F.count("*") if cond is None else F.count_if(cond)).alias(name)) for name, (df, cond) in tables.items()
    ]
    return beside(*parts)


def run_summary(runs: DataFrame, dataset: str, score: str, key: str, n: int = 8) -> DataFrame:
    """The ``n`` best runs per dataset with the spread and mean of all its scores.

    The limit on the row number reaches the map side (WindowGroupLimit), so that a dataset with very many runs
    sends only a few rows per task into its window.
    """
    scored = runs.where(quoted(score).isNotNull())
    place = F.row_number().over(Window.partitionBy(quoted(dataset)).orderBy(F.desc(score), quoted(key)))
    best = scored.withColumn("place", place).where(F.col("place") <= n)
    stats = scored.groupBy(quoted(dataset)).agg(
        F.count("*").alias("runs"), (F.max(score) - F.min(score)).alias("spread"), F.avg(score).alias("mean")
    )
    return best.select(dataset, key, score, "place").join(stats, dataset)


def registry_stats(registry: DataFrame) -> DataFrame:
    """Models by stage and their mean accuracy in percent."""
    stage = lambda s: F.count_if(F.lower("status") == s)
    return registry.agg(
        F.count("*").alias("total"),
        stage("production").alias("production"),
        stage("staging").alias("staging"),
        stage("archived").alias("archived"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)) * 100, 1).alias("avg_accuracy"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """Completed, failed and active runs and the success rate in percent."""
    done = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    ended = done + failed
    return runs.agg(
        F.count("*").alias("total"),
        done.alias("completed"),
        failed.alias("failed"),
        (F.count("*") - ended).alias("active"),
        F.when(ended > 0, F.round(done / ended * 100, 1)).alias("success_rate"),
    )


def dataset_status(datasets: DataFrame, anchor: str) -> DataFrame:
    """Ready datasets, those needing attention, new ones of the week and all rows."""
    fresh = F.col("created_at") >= F.lit(anchor).cast("date") - F.expr("INTERVAL 7 DAYS")
    return datasets.agg(
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") != "ready").alias("attention"),
        F.count_if(fresh).alias("new_this_week"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_rows"),
    )


def query_history(log: DataFrame, query: str) -> DataFrame:
    """Runs, failures, time and rows per query text."""
    return log.groupBy(quoted(query)).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") != "success").alias("failures"),
        F.avg("duration_ms").alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum("rows").cast("bigint").alias("rows"),
    )


# Patterns that may never run
DISALLOWED = [
    r"\bdrop\s+(view|database|schema|index|function|procedure|trigger|macro)\b",
    r"\balter\s+(view|schema|database|function|type)\b",
    r"\bcreate\s+(or\s+replace\s+)?(database|schema|index|function|procedure|trigger|macro|secret|type)\b",
    r"\bgrant\b", r"\brevoke\b", r"\battach\b", r"\bdetach\b", r"\bexec\b", r"\bexecute\b", r"\bshutdown\b",
    r"\binstall\b", r"\bload\b", r"\binformation_schema\b", r"\bpg_catalog\b", r"\bsqlite_master\b", r"\bpragma\b",
    r"\bwrite\b", r"\bcopy\b", r"\bmount\b", r"\bmemory_limit\b", r"\bread_csv\b", r"\bread_parquet\b",
    r"\bread_json\b", r"\bread_csv_auto\b", r"\breads\b", r"\bglob\b",
]
# Operations that need a confirmation
DESTRUCTIVE = {
    "insert": r"\binsert\s+into\b",
    "update": r"\bupdate\s+\w+\s+set\b",
    "delete": r"\bdelete\s+from\b",
    "drop table": r"\bdrop\s+table\b",
    "alter table": r"\balter\s+table\b",
    "create table": r"\bcreate\s+(or\s+replace\s+)?table\b",
    "truncate": r"\btruncate\b",
    "replace": r"\breplace\b",
    "rename": r"\brename\b",
}


def sql_flags(log: DataFrame, text: str) -> DataFrame:
    """Add ``disallowed`` and the list of destructive ``operations`` found in each logged query text."""
    plain = F.regexp_replace(quoted(text), r"(?s)/\*.*?\*/", " ")
    plain = F.lower(F.regexp_replace(plain, r"(--|#)[^\n]*", " "))
    # a column of its own, so that the cleaned text is made once per row
    read = log.withColumn("_plain", plain)
    found = F.array(*[F.when(F.col("_plain").rlike(p), F.lit(name)) for name, p in DESTRUCTIVE.items()])
    flags = {"disallowed": F.col("_plain").rlike("|".join(DISALLOWED)), "operations": F.array_compact(found)}
    return read.withColumns(flags).drop("_plain")
