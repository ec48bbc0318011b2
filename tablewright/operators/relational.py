"""Searching, paging, sampling and reconciling tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.prep import hash_position
from tablewright.plans.ordered import row_numbers, rows_between
from tablewright.plans.selection import first_rows_bound
from tablewright.plans.types import known, quoted

#: Positions up to which a page is taken by a top-n; beyond, rows are numbered.
TOP_ROWS = 10_000
HITS_PER_TABLE = 10


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def contains_terms(col: Column, *terms: str) -> Column:
    """Case-insensitive: all terms in this order."""
    return col.ilike("%" + "%".join(terms) + "%")


def above_average(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(known(df, column))).first()[0]
    return df.where(known(df, column) > F.lit(mean))


def recent_days(df: DataFrame, column: str, anchor: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the anchor date."""
    return df.where(quoted(column) >= F.lit(anchor).cast("date") - F.expr(f"INTERVAL {days} DAYS"))


def history_page(
    df: DataFrame,
    key: str,
    search: str = "",
    search_in: Sequence[str] = (),
    equal: Mapping[str, object] | None = None,
    sort_by: str | None = None,
    sortable: Sequence[str] = (),
    descending: bool = True,
    offset: int = 0,
    limit: int = 50,
) -> DataFrame:
    """A page of the filtered rows with the number of all matching rows in ``total``.

    Unknown sort columns fall back to the first sortable one; nulls come last; ``key`` breaks ties.
    """
    found = df
    for name, value in (equal or {}).items():
        found = found.where(quoted(name) == F.lit(value))
    if search.strip():
        pattern = f"%{search.strip().lower()}%"
        found = found.where(any_of([F.lower(F.coalesce(quoted(c).cast("string"), F.lit(""))).like(pattern) for c in search_in]))
    column = quoted(sort_by if sort_by in sortable else sortable[0])
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    page = found.orderBy(order, quoted(key)).offset(offset).limit(limit)
    return page.withColumn("total", F.lit(found.count()).cast("bigint"))


def global_search(tables: Mapping[str, tuple[DataFrame, str, Sequence[str]]], term: str, hits: int = HITS_PER_TABLE) -> DataFrame:
    """Up to ``hits`` matches per table, as (entity, id, title); tables are name -> (df, key, columns searched)."""
    out = None
    for name, (df, key, columns) in tables.items():
        match = any_of([quoted(c).cast("string").ilike(f"%{term}%") for c in columns])
        found = df.where(match).orderBy(quoted(key)).limit(hits)
        rows = found.select(F.lit(name).alias("entity"), quoted(key).cast("string").alias("id"), quoted(columns[0]).cast("string").alias("title"))
        out = rows if out is None else out.unionByName(rows)
    return out


def grid(df: DataFrame, search: str = "", contains: Mapping[str, str] | None = None, sort: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    """Rows where any column contains ``search`` and each given column its text; sorted by several keys."""
    out = df
    if search:
        text = F.lower(F.concat_ws("\x1f", *[quoted(c).cast("string") for c in df.columns]))
        out = out.where(text.contains(search.lower()))
    for c, part in (contains or {}).items():
        out = out.where(F.lower(quoted(c).cast("string")).contains(part.lower()))
    keys = [quoted(c).desc() if desc else quoted(c).asc() for c, desc in sort]
    return out.orderBy(*keys) if keys else out


def align_columns(df: DataFrame, expected: Sequence[str], missing: str = "error") -> tuple[DataFrame, dict]:
    """The expected columns in their order; missing ones are an error or 0, extra ones are dropped and reported."""
    absent = [c for c in expected if c not in df.columns]
    if absent and missing == "error":
        raise ValueError(f"missing features: {', '.join(absent)}")
    out = df.select(*[quoted(c) if c not in absent else F.lit(0.0).alias(c) for c in expected])
    return out, {"missing": absent, "dropped": [c for c in df.columns if c not in expected]}


def page(df: DataFrame, order_by: Sequence[str], number: int, size: int, cap: int | None = None) -> DataFrame:
    """Page ``number`` (from 0) of a totally ordered result, with the exact total and a truncated flag.

    With ``cap``, rows beyond that position belong to no page, and the flag says so.
    """
    total, low, high = df.count(), number * size, (number + 1) * size
    high = high if cap is None else min(high, cap)
    if high <= TOP_ROWS:
        rows = df.orderBy(*order_by).limit(max(high, 0)).offset(low)
    else:
        rows = rows_between(df, order_by, low, high, total)
    return rows.withColumns({"total": F.lit(total).cast("bigint"), "truncated": F.lit(cap is not None and total > cap)})


def sample_evenly(df: DataFrame, order_by: Sequence[str], k: int) -> DataFrame:
    """The rows at positions floor(i * (n - 1) / (k - 1)), i < k, of the ordered table; all rows if n <= k."""
    n = df.count()
    if n <= k:
        return df
    if k <= 1:
        return df.orderBy(*order_by).limit(k)
    numbered = row_numbers(df, order_by, "_row", rows=n)
    at = F.col("_row") - 1
    nearest = F.expr(f"(_row - 1) * {k - 1}L div {n - 1}L")
    # position p is taken when some i with i * (n-1) in [p * (k-1), (p+1) * (k-1)) exists
    hit = any_of([F.expr(f"{i} * {n - 1}L div {k - 1}L") == at for i in ("(_i)", "(_i + 1)")])
    return numbered.withColumn("_i", nearest).where(hit).drop("_i", "_row")


def sample_rows(df: DataFrame, keys: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """``k`` rows, the first by a hash of their (unique) key: repeatable, and the same on any partitioning."""
    return df.where(first_rows_bound(df, [hash_position(keys, seed), *[quoted(c) for c in keys]], k))


def visible_datasets(datasets: DataFrame, shares: DataFrame, user_id: object, email: str) -> DataFrame:
    """Datasets without owner, owned by the user, from the samples, or shared with the user by id or address."""
    mine = shares.where(
        (F.col("shared_with_user_id") == F.lit(user_id)) | (F.lower("shared_with_email") == email.lower())
    )
    mine = mine.select(F.col("dataset_id").alias("_shared")).distinct()
    open_ = F.col("owner_id").isNull() | (F.col("owner_id") == F.lit(user_id)) | (F.col("source") == "sample")
    joined = datasets.join(mine, datasets["id"] == mine["_shared"], "left")
    return joined.where(open_ | F.col("_shared").isNotNull()).drop("_shared")


def reconcile_registry(files: DataFrame, registry: DataFrame, suffix: str = ".pkl") -> DataFrame:
    """Model files and registered models, matched by name with or without suffix; staged models with a file are ready."""
    f = files.select(F.col("name").alias("_file"), F.col("size_kb"))
    name = F.col("name")
    r = registry.select(
        name.alias("_registered"),
        "status",
        F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix))).alias("_as_file"),
    )
    both = f.join(r, F.col("_file") == F.col("_as_file"), "full")
    has_file, known_ = F.col("_file").isNotNull(), F.col("_registered").isNotNull()
    staged = F.coalesce(F.col("status"), F.lit("")).isin("", "staging")
    return both.select(
        F.coalesce("_file", "_registered").alias("name"),
        F.when(~known_ | (staged & has_file), "ready").otherwise(F.col("status")).alias("status"),
        known_.alias("registered"),
        has_file.alias("has_file"),
        "size_kb",
    )


def project_counts(projects: DataFrame, key: str, parts: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per project the number of rows in each part table (zero kept); every part is counted before the join."""
    out = projects
    for name, (df, foreign) in parts.items():
        counts = df.groupBy(quoted(foreign).alias(key)).agg(F.count("*").alias(name))
        out = out.join(counts, key, "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in parts})


def merge_explanations(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two attribution tables (feature, value) side by side, the missing side 0 and positive, strongest first."""
    a = first.select("feature", F.col("value").alias("first_value"))
    b = second.select("feature", F.col("value").alias("second_value"))
    both = a.join(b, "feature", "full").fillna(0.0, ["first_value", "second_value"])
    direction = lambda c: F.when(F.col(c) < 0, "negative").otherwise("positive")
    both = both.withColumns({"first_direction": direction("first_value"), "second_direction": direction("second_value")})
    return both.orderBy(F.desc(F.abs("first_value") + F.abs("second_value")), "feature")
