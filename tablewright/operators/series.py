"""Features of ordered rows: lags, rolling statistics, changes between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.plans import ordered
from tablewright.plans.ordered import fill, join_back, ranks, row_numbers, windowed
from tablewright.plans.types import quoted

LAGS = (1, 2, 3, 5, 7)
#: Rows of a chunk where many columns look back: small, so that their sorts fill all cores evenly.
SERIES_CHUNK_ROWS = 250_000


def lag_features(df: DataFrame, target: str, order_by: Sequence[str], partition_by: Sequence[str] = (), lags: Sequence[int] = LAGS) -> DataFrame:
    """``lag_<k>`` columns of the target."""
    return windowed(
        df, partition_by, order_by, lambda w: {f"lag_{k}": F.lag(quoted(target), k).over(w) for k in lags}, before=max(lags)
    )


def _rolling(df: DataFrame, target: str, exclude_current: bool):
    end = -1 if exclude_current else 0

    def full(window, n: int, stat) -> Column:
        frame = window.rowsBetween(end - n + 1, end)
        return F.when(F.count(quoted(target)).over(frame) == n, stat(quoted(target)).over(frame))

    return lambda w: {
        "rolling_mean_3": full(w, 3, F.avg),
        "rolling_mean_7": full(w, 7, F.avg),
        "rolling_std_3": full(w, 3, F.stddev_samp),
    }


def rolling_features(
    df: DataFrame, target: str, order_by: Sequence[str], partition_by: Sequence[str] = (), exclude_current: bool = False
) -> DataFrame:
    """Rolling mean (3, 7) and deviation (3), null until the window is full.

    The window holds the current row unless ``exclude_current``, which keeps the target out of its own features.
    """
    return windowed(df, partition_by, order_by, _rolling(df, target, exclude_current), before=7)


def series_features(
    df: DataFrame, target: str, order_by: Sequence[str], partition_by: Sequence[str] = (), exclude_current: bool = False, rows: int | None = None
) -> DataFrame:
    """Lags and rolling statistics; rows without a full history are dropped.  ``rows`` is the number of rows if known."""
    rolling = _rolling(df, target, exclude_current)

    def columns(w):
        return {**{f"lag_{k}": F.lag(quoted(target), k).over(w) for k in LAGS}, **rolling(w)}

    out = windowed(df, partition_by, order_by, columns, before=7, rows=rows, chunk_rows=min(ordered.CHUNK_ROWS, SERIES_CHUNK_ROWS))
    return out.dropna(subset=[c for c in out.columns if c not in df.columns])


def neighbours(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """Previous and next value, and the first and last of the partition, of every row."""
    out = windowed(
        df,
        partition_by,
        order_by,
        lambda w: {"previous": F.lag(quoted(column)).over(w), "next": F.lead(quoted(column)).over(w)},
        before=1,
        after=1,
    )
    order = F.struct(*[quoted(c) for c in order_by])
    ends = df.groupBy(*[quoted(c) for c in partition_by]).agg(
        F.min_by(quoted(column), order).alias("first_value"),
        F.max_by(quoted(column), order).alias("last_value"),
        F.count("*").alias("_n"),
    )
    return join_back(out, ends, partition_by, "_n")


def ntiles(df: DataFrame, order_by: Sequence[str], n: int = 10, name: str = "ntile") -> DataFrame:
    """Which of ``n`` nearly equal groups each row falls in; the first rows % n groups hold one more."""
    total = df.count()
    numbered = row_numbers(df, order_by, "_row", rows=total)
    small, extra = total // n, total % n
    at = F.col("_row") - 1
    edge = extra * (small + 1)
    tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - edge) / max(small, 1)))
    return numbered.withColumn(name, (tile + 1).cast("int")).drop("_row")


def week_over_week(df: DataFrame, ts: str, anchor: str) -> DataFrame:
    """Rows of the seven days up to the anchor date against the seven before, with the change in percent."""
    day = quoted(ts).cast("date")
    end = F.lit(anchor).cast("date")
    age = F.datediff(end, day)
    out = df.agg(
        F.count_if((age >= 0) & (age < 7)).alias("this_week"), F.count_if((age >= 7) & (age < 14)).alias("last_week")
    )
    change = F.when(F.col("last_week") > 0, (F.col("this_week") - F.col("last_week")) / F.col("last_week") * 100)
    return out.withColumn("change_pct", F.round(change, 1))


__all__ = [
    "LAGS", "fill", "lag_features", "neighbours", "ntiles", "ranks", "rolling_features",
    "row_numbers", "series_features", "week_over_week",
]
