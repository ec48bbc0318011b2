"""Many statistics of many columns from one scan, and their unpivoting into rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

# Aggregates per job: keeps the generated code of one aggregate in bounds on very wide tables.
AGGREGATES_PER_SCAN = 400


def fetch(df: DataFrame, exprs: Mapping[str, Column]) -> dict:
    """Evaluate global aggregates and return them by name (one row per scan reaches the driver)."""
    names = list(exprs)
    out: dict = {}
    for start in range(0, len(names), AGGREGATES_PER_SCAN):
        block = names[start : start + AGGREGATES_PER_SCAN]
        row = df.agg(*[exprs[n].alias(f"_{i}") for i, n in enumerate(block)]).first()
        out.update({n: row[i] for i, n in enumerate(block)})
    return out


def unpivot_stats(df: DataFrame, columns: Iterable[str], stats: Mapping[str, object], label: str = "column_name") -> DataFrame:
    """One row per column holding the given aggregates; ``stats[name](column_name)`` builds each of them.

    All aggregates run in a single job over ``df``; the one wide row is then stacked into long form.
    """
    columns = list(columns)
    wide = df.agg(*[make(c).alias(f"_{i}_{s}") for i, c in enumerate(columns) for s, make in stats.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias(label), *[F.col(f"_{i}_{s}").alias(s) for s in stats])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def rows_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A DataFrame of finished results, one row per column or class (bounded by the schema, not by the data)."""
    return spark.createDataFrame([r if isinstance(r, (tuple, Row)) else tuple(r) for r in rows], schema)
