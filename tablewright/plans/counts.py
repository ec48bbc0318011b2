"""Value counts of many columns at once: the base of distinct counts, modes, categories and top values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablewright.plans.types import known, quoted


def _by_type(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Rows (column_name, v, n) of the non-null values, one frame for each data type among the columns.

    Values keep their type until they are counted: turning every number of a table into text costs more than
    the extra scan.  Hot values are folded on the map side.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = []
    for names in kinds.values():
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), known(df, c).alias("v")) for c in names])
        rows = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
        out.append(rows.groupBy("column_name", "v").agg(F.count("*").alias("n")))
    return out


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, value, cnt) of the non-null values, each value as text."""
    texts = [c.select("column_name", F.col("v").cast("string").alias("value"), F.col("n").alias("cnt")) for c in _by_type(df, columns)]
    return reduce(DataFrame.unionByName, texts)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact number of distinct non-null values per column, in one job."""
    if not columns:
        return {}
    sizes = [c.groupBy("column_name").agg(F.count("*").alias("n")) for c in _by_type(df, columns)]
    found = {r["column_name"]: r["n"] for r in reduce(DataFrame.unionByName, sizes).collect()}
    return {c: found.get(c, 0) for c in columns}


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent non-null value per column in its own type, ties to the smallest; columns without values are left out."""
    out = {}
    for counts in _by_type(df, columns):
        best = counts.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("best"))
        out.update({r["column_name"]: r["best"]["v"] for r in best.collect()})
    return out


def counted_categories(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, dict]:
    """Distinct non-null values with their counts, in order; more than ``limit`` values in a column are an error."""
    found: dict[str, dict] = {c: {} for c in columns}
    for counts in _by_type(df, columns):
        rows = counts.limit((limit + 1) * len(columns)).collect()
        for r in rows:
            found[r["column_name"]][r["v"]] = r["n"]
        if len(rows) > limit * len(columns) or any(len(v) > limit for v in found.values()):
            wide = [c for c, v in found.items() if len(v) > limit] or list(columns)
            raise ValueError(f"more than {limit} distinct values in {', '.join(wide)}")
    return {c: dict(sorted(v.items())) for c, v in found.items()}


def categories(df: DataFrame, column: str, limit: int) -> list:
    """Distinct non-null values in order; raises when there are more than ``limit`` of them."""
    return list(counted_categories(df, [column], limit)[column])
