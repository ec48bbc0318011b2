"""Cleaning stages.  Each takes a DataFrame and returns ``(df, stats)``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.profile import column_kinds, numeric_summary
from tablewright.plans import wide
from tablewright.plans.counts import counted_categories, distinct_counts, modes
from tablewright.plans.durable import durable
from tablewright.plans.ordered import fill, join_back, row_numbers
from tablewright.plans.selection import quantiles
from tablewright.plans.types import is_numeric, known, numeric_columns, quoted, text_columns

ONE_HOT_LIMIT = 200


def _missing(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    return wide.fetch(df, {c: F.count_if(known(df, c).isNull()) for c in columns}) if columns else {}


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace columns in place, keeping their order."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


# --- missing values ---------------------------------------------------------------------------------


def fill_values(df: DataFrame, method: str, columns: Sequence[str], value: object = None) -> dict[str, object]:
    """The value that replaces missing cells, per column; columns without one are left out."""
    if method in ("constant", "unknown"):
        return {c: value if method == "constant" else "unknown" for c in columns}
    if method == "mode":
        found = modes(df, columns)
        return {c: found.get(c, "unknown") for c in columns}
    if method not in ("mean", "median", "zero"):
        raise ValueError(f"unknown imputation method {method!r}")
    kinds = column_kinds(df.select(*[quoted(c) for c in columns]))
    numbers = [c for c in columns if kinds[c] == "numeric"]
    out = fill_values(df, "mode", [c for c in columns if c not in numbers])
    as_number = {c: _number(df, c) for c in numbers}
    if method == "zero":
        out.update({c: 0.0 for c in numbers})
    elif method == "mean" and numbers:
        out.update(wide.fetch(df, {c: F.avg(v) for c, v in as_number.items()}))
    elif numbers:
        out.update({c: v[0] for c, v in quantiles(df, {c: (v, [0.5]) for c, v in as_number.items()}).items()})
    return {c: v for c, v in out.items() if v is not None}


def _number(df: DataFrame, c: str) -> Column:
    return known(df, c) if is_numeric(df.schema[c].dataType) else quoted(c).try_cast("double")


def impute(
    df: DataFrame,
    method: str = "median",
    columns: Sequence[str] = (),
    value: object = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> tuple[DataFrame, dict]:
    """Fill missing cells by mean, median, zero, mode, constant, unknown, ffill or bfill.

    A text value turns a column of another type into text.  Numeric methods treat text that mostly parses as a number as one and give other columns their mode.
    ``ffill`` and ``bfill`` need ``order_by``.
    """
    columns = list(columns) or df.columns
    holes = _missing(df, columns)
    target = [c for c in columns if holes[c]]
    if method in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{method} needs order_by")
        out = fill(df, target, order_by, partition_by, forward=method == "ffill") if target else df
        left = _missing(out, target)
    else:
        values = fill_values(df, method, target, value)
        new, left = {}, {c: holes[c] for c in target if c not in values}
        for c, v in values.items():
            source = known(df, c)
            if method in ("mean", "median", "zero") and isinstance(v, float):
                source = _number(df, c).cast("double")
            elif isinstance(v, str):
                source = source.cast("string")  # numbers filled with text become text
            new[c] = F.coalesce(source, F.lit(v))
        out = _replace(df, new)
    before, after = sum(holes.values()), sum(left.values())
    return out, {"before": before, "after": after, "filled": before - after}


# --- duplicates -------------------------------------------------------------------------------------


def dedup(
    df: DataFrame, order_by: Sequence[str] = (), keep: str = "first", subset: Sequence[str] = (), count: bool = True
) -> tuple[DataFrame, dict]:
    """One row per group of rows equal in ``subset`` (default: every column but the order columns).

    The survivor is the first or last in ``order_by``; without it any, for the rows are then identical.
    The choice is an aggregate, so copies are folded on the map side however hot a group is.
    Without ``count`` nothing runs yet and the stats are empty.
    """
    keys = list(subset) or [c for c in df.columns if c not in order_by]
    group = [known(df, c).alias(c) for c in keys]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        out = df.select(*group).distinct()
    else:
        order = F.struct(*[quoted(c) for c in (order_by or rest)])
        pick = F.max_by if keep == "last" else F.min_by
        kept = df.groupBy(*group).agg(pick(F.struct(*[quoted(c) for c in rest]), order).alias("_kept"))
        out = kept.select(*[quoted(c) if c in keys else F.col("_kept")[c].alias(c) for c in df.columns])
    if not count:
        return out, {}
    before = df.count()
    after = out.count()
    return out, {"before": before - after, "after": 0, "removed": before - after}


# --- outliers ---------------------------------------------------------------------------------------


def fences(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 3.0) -> dict[str, tuple]:
    """Lower and upper limit per numeric column; columns without a spread have no limits under z-score."""
    out = {}
    if method == "iqr":
        for c, (q1, q3) in quantiles(df, {c: (known(df, c), [0.25, 0.75]) for c in columns}).items():
            if q1 is not None:
                out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    elif method == "zscore":
        got = wide.fetch(df, {f"{k}|{c}": f(known(df, c)) for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))})
        for c in columns:
            mean, std = got[f"m|{c}"], got[f"s|{c}"]
            if std:
                out[c] = (mean - threshold * std, mean + threshold * std)
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return out


def _outside(df: DataFrame, c: str, limits: tuple) -> Column:
    value = known(df, c)
    return F.coalesce((value < F.lit(limits[0])) | (value > F.lit(limits[1])), F.lit(False))


def clip(value: Column, low: Column, high: Column) -> Column:
    """Clamp to [low, high]; null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def flag_outliers(
    df: DataFrame, columns: Sequence[str] = (), method: str = "iqr", threshold: float = 3.0
) -> tuple[DataFrame, dict]:
    """Add ``<column>_outlier`` flags."""
    columns = list(columns) or numeric_columns(df)
    limits = fences(df, columns, method, threshold)
    flags = {c: _outside(df, c, limits[c]) if c in limits else F.lit(False) for c in columns}
    out = df.withColumns({f"{c}_outlier": f for c, f in flags.items()})
    return out, wide.fetch(df, {c: F.count_if(f) for c, f in flags.items()})


def outliers(
    df: DataFrame,
    action: str,
    columns: Sequence[str] = (),
    method: str = "iqr",
    threshold: float = 3.0,
) -> tuple[DataFrame, dict]:
    """Remove the rows with outliers, cap the cells at the limits, or replace them by the median."""
    columns = [c for c in (list(columns) or numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
    limits = fences(df, columns, method, threshold)
    flags = {c: _outside(df, c, lim) for c, lim in limits.items()}
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag = any_flag | f
    counts = wide.fetch(df, {**{c: F.count_if(f) for c, f in flags.items()}, "": F.count_if(any_flag)})
    rows = counts.pop("")
    hit = [c for c, n in counts.items() if n]
    if action == "remove":
        return df.where(~any_flag), {"before_counts": counts, "rows_removed": rows, "cells_replaced": 0}
    if action == "keep":
        return df, {"before_counts": counts, "rows_removed": 0, "cells_replaced": 0}
    if action == "cap":
        new = {c: clip(known(df, c).cast("double"), F.lit(limits[c][0]), F.lit(limits[c][1])) for c in hit}
    elif action == "median":
        middle = quantiles(df, {c: (known(df, c), [0.5]) for c in hit})
        new = {c: F.when(flags[c], F.lit(middle[c][0])).otherwise(known(df, c).cast("double")) for c in hit}
    else:
        raise ValueError(f"unknown outlier action {action!r}")
    return _replace(df, new), {"before_counts": counts, "rows_removed": 0, "cells_replaced": sum(counts.values())}


# --- encoding ---------------------------------------------------------------------------------------


def dummy_name(column: str, value: object) -> str:
    text = "nan" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return re.sub(r"[^0-9A-Za-z_]+", "_", f"{column}_{text}")


def one_hot(
    df: DataFrame, columns: Sequence[str], max_categories: int = ONE_HOT_LIMIT, drop_first: bool = False
) -> tuple[DataFrame, dict]:
    """Replace each column by one boolean column per category, in alphabetical order, plus one for null.

    The categories are listed once (at most ``max_categories`` per column); beyond that it is an error.
    Categories that differ in case only give names that need ``spark.sql.caseSensitive`` to be told apart.
    """
    holes = _missing(df, columns)
    added: dict[str, Column] = {}
    found = counted_categories(df, columns, max_categories)
    for c in columns:
        values = list(found[c])
        if not drop_first and holes[c]:
            values = [*values, None]
        if len(values) > max_categories:
            raise ValueError(f"column {c!r} has more than {max_categories} categories")
        for v in values[1:] if drop_first else values:
            hit = known(df, c).isNull() if v is None else known(df, c).eqNullSafe(F.lit(v))
            name, n = dummy_name(c, v), 2
            while name in added:  # categories that read alike once cleaned
                name, n = f"{dummy_name(c, v)}_{n}", n + 1
            added[name] = hit
    kept = [quoted(c) for c in df.columns if c not in columns]
    out = df.select(*kept, *[col.alias(name) for name, col in added.items()])
    return out, {"new_columns": list(added), "after_columns": out.columns}


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, code, cnt): position of each distinct value in order, from 0."""
    counts = (
        df.where(known(df, column).isNotNull())
        .groupBy(quoted(column).alias(column))
        .agg(F.count("*").alias("cnt"))
    )
    return row_numbers(counts, [column], "code").withColumn("code", (F.col("code") - 1).cast("int"))


def label_encode(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict]:
    """Replace values by their alphabetical code from 0, null by -1."""
    out, classes = df, {}
    for c in columns:
        codes = durable(label_codes(df, c).withColumnRenamed("code", "_code"))
        classes[c] = codes.count()
        joined = join_back(out, codes, [c], "cnt", how="left", size=classes[c])
        out = joined.select(
            *[F.coalesce("_code", F.lit(-1)).alias(c) if n == c else quoted(n) for n in out.columns]
        )
    return out, {"classes": classes}


def ordinal_encode(df: DataFrame, columns: Sequence[str], orders: Mapping[str, Sequence] | None = None) -> tuple[DataFrame, dict]:
    """Replace values by their position in the given order (else sorted); unknown and null become null.

    The stats hold the given orders, and the number of values of columns without one.
    """
    new, used, out = {}, {}, df
    for c in columns:
        order = list((orders or {}).get(c) or ())
        if order:
            place = F.array_position(F.array(*[F.lit(v) for v in order]), quoted(c))
            new[c] = F.when(place > 0, (place - 1).cast("double"))
            used[c] = order
    out = _replace(df, new)
    sizes = {}
    for c in columns:
        if c not in used:
            codes = durable(label_codes(df, c).withColumnRenamed("code", "_code"))
            sizes[c] = codes.count()
            joined = join_back(out, codes, [c], "cnt", how="left", size=sizes[c])
            out = joined.select(*[F.col("_code").cast("double").alias(c) if n == c else quoted(n) for n in out.columns])
    return out, {"orders": used, "values": sizes}


def encode(
    df: DataFrame,
    methods: Mapping[str, str],
    orders: Mapping[str, Sequence] | None = None,
    max_categories: int = ONE_HOT_LIMIT,
) -> tuple[DataFrame, dict]:
    """Encode each column by its own method: one_hot, label or ordinal."""
    before, out = df.columns, df
    for method in ("label", "ordinal", "one_hot"):
        chosen = [c for c, m in methods.items() if m == method]
        if not chosen:
            continue
        if method == "one_hot":
            out, _ = one_hot(out, chosen, max_categories)
        elif method == "label":
            out, _ = label_encode(out, chosen)
        else:
            out, _ = ordinal_encode(out, chosen, orders)
    unknown = set(methods.values()) - {"label", "ordinal", "one_hot"}
    if unknown:
        raise ValueError(f"unknown encoding {sorted(unknown)}")
    return out, {"new_columns": [c for c in out.columns if c not in before], "after_columns": out.columns}


# --- scaling ----------------------------------------------------------------------------------------


def scale(df: DataFrame, method: str = "standard", columns: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Scale numeric columns: standard (sample deviation), minmax or robust; columns without spread are skipped."""
    columns = [c for c in (list(columns) or numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
    stats = numeric_summary(df, columns, outliers=False)
    new, skipped = {}, {}
    for c, s in stats.items():
        if method == "standard":
            centre, spread = s["mean"], s["std"]
        elif method == "minmax":
            centre, spread = s["min"], s["n"] and s["max"] - s["min"]
        elif method == "robust":
            centre, spread = s["median"], s["iqr"]
        else:
            raise ValueError(f"unknown scaling method {method!r}")
        if spread:
            new[c] = (known(df, c) - F.lit(centre)) / F.lit(spread)
        else:
            skipped[c] = "constant" if s["n"] else "empty"
    ranges = {c: (stats[c]["min"], stats[c]["max"]) for c in new}
    return _replace(df, new), {"scaled": len(new), "skipped": skipped, "old_ranges": ranges}


# --- composites -------------------------------------------------------------------------------------


def drop_low_variance(df: DataFrame, threshold: float = 0.01) -> tuple[DataFrame, dict]:
    """Drop numeric columns whose sample variance is below the threshold."""
    columns = numeric_columns(df)
    got = wide.fetch(df, {c: F.var_samp(known(df, c)) for c in columns}) if columns else {}
    dropped = [c for c in columns if got[c] is not None and got[c] < threshold]
    return df.drop(*dropped), {"dropped": dropped}


def batch(df: DataFrame, operations: Sequence[Mapping]) -> tuple[DataFrame, dict]:
    """Apply a list of operations in order: impute_missing, encode_categorical, feature_selection."""
    out, applied = df, []
    for op in operations:
        kind, columns = op["type"], list(op.get("columns", []))
        if kind == "impute_missing":
            out, stats = impute(out, op.get("strategy", "median"), [c for c in columns if c in out.columns])
        elif kind == "encode_categorical":
            texts = set(text_columns(out))
            out, stats = one_hot(out, [c for c in columns if c in texts], drop_first=True)
        elif kind == "feature_selection":
            out, stats = drop_low_variance(out, op.get("threshold", 0.01))
        else:
            continue
        applied.append((kind, stats))
    return out, {"applied": applied}


def auto(df: DataFrame) -> tuple[DataFrame, dict]:
    """Impute, drop copies, one-hot encode text, remove outliers column after column, scale to [0, 1].

    Each column's fences come from the rows that the columns before it left, so every column needs its own
    scan; the de-duplicated table is written once and those scans read it back.
    """
    out, imputed = impute(df, "median")
    total = df.count()
    out, _ = dedup(out, count=False)
    out = durable(out)
    copies = total - out.count()
    kinds = column_kinds(out)
    texts = [c for c in text_columns(out) if kinds[c] != "datetime"]
    out, encoded = one_hot(out, texts, drop_first=True)
    removed = 0
    for c in numeric_columns(out):
        limits = fences(out, [c])
        if c in limits:
            flag = _outside(out, c, limits[c])
            n = out.agg(F.count_if(flag)).first()[0]
            if n:
                removed += n
                out = out.where(~flag)
    out, scaled = scale(out, "minmax")
    return out, {
        "missing_imputed": imputed["filled"],
        "duplicates_removed": copies,
        "categorical_encoded": len(texts),
        "outliers_removed": removed,
        "features_scaled": scaled["scaled"],
        "new_columns": encoded["new_columns"],
    }


ID_COLUMNS = ["id", "index", "unnamed: 0", "unnamed:0"]  # fixed values: names that never are features


def drop_ids(df: DataFrame) -> DataFrame:
    """Drop identifier columns by name."""
    return df.drop(*[c for c in df.columns if c.strip().lower() in ID_COLUMNS or c.strip().lower().endswith("_id")])


def drop_constants(df: DataFrame) -> DataFrame:
    """Drop numeric columns with at most one distinct value."""
    columns = numeric_columns(df)
    got = wide.fetch(df, {f"{k}|{c}": f(known(df, c)) for c in columns for k, f in (("a", F.min), ("b", F.max))})
    return df.drop(*[c for c in columns if got[f"a|{c}"] == got[f"b|{c}"]])


def drop_high_cardinality(df: DataFrame, rule: str = "engine") -> DataFrame:
    """Drop text columns with too many values: >50 or more than half the rows (engine), or id-like names (prep)."""
    marks = ["id", "uuid", "guid", "token", "hash", "key", "url"]  # fixed values
    texts = [c for c in text_columns(df) if rule == "engine" or any(m in c.lower() for m in marks)]
    if not texts:
        return df
    total, unique = df.count(), distinct_counts(df, texts)

    def too_many(c: str) -> bool:
        share = unique[c] / max(total, 1)
        if rule == "engine":
            return unique[c] > 50 or share > 0.5
        return share > 0.9 and unique[c] > 30

    return df.drop(*[c for c in texts if too_many(c)])
