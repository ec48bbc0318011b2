"""Column profiles and quality measures of a whole table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.plans import wide
from tablewright.plans.counts import distinct_counts, value_counts
from tablewright.plans.selection import quantiles
from tablewright.plans.types import is_date, is_numeric, known, numeric_columns, quoted, rounded, text_columns

Z_LIMIT = 3.0
NUMBER_SHARE = 0.8
DATE_SHARE = 0.5
# How text must begin to be tried as a number or as a date or time
NUMBER_START = r"(?i)^\s*[+-]?(\d|\.\d|inf|nan)"
DATE_START = r"^\s*([+-]?\d{4,7}(-|\s*$)|T?\d{1,2}:)"


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, outliers: bool = True) -> dict[str, dict]:
    """Count, moments, exact quartiles, IQR fences and outlier counts of each numeric column.

    Three scans whatever the number of columns: moments, quartiles, outliers.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    values = {c: known(df, c) for c in columns}
    exprs: dict[str, Column] = {"rows": F.count("*")}
    for c, v in values.items():
        exprs.update(
            {
                f"{c}|n": F.count(v),
                f"{c}|mean": F.avg(v),
                f"{c}|std": F.stddev_samp(v),
                f"{c}|min": F.min(v).cast("double"),
                f"{c}|max": F.max(v).cast("double"),
            }
        )
    got = wide.fetch(df, exprs)
    out = {c: {k: got[f"{c}|{k}"] for k in ("n", "mean", "std", "min", "max")} for c in columns}
    quarts = quantiles(df, {c: (values[c], [0.25, 0.5, 0.75]) for c in columns}, {c: out[c]["n"] for c in columns})
    for c, s in out.items():
        s["rows"], s["missing"] = got["rows"], got["rows"] - s["n"]
        s["q1"], s["median"], s["q3"] = quarts[c]
        empty = s["n"] == 0
        s["iqr"] = None if empty else s["q3"] - s["q1"]
        s["lower"] = None if empty else s["q1"] - 1.5 * s["iqr"]
        s["upper"] = None if empty else s["q3"] + 1.5 * s["iqr"]
    if outliers:
        checks = {}
        for c, s in out.items():
            if s["n"]:
                checks[f"{c}|iqr"] = F.count_if((values[c] < s["lower"]) | (values[c] > s["upper"]))
                if s["std"]:
                    checks[f"{c}|z"] = F.count_if(F.abs(values[c] - s["mean"]) / s["std"] > Z_LIMIT)
        hits = wide.fetch(df, checks) if checks else {}
        for c, s in out.items():
            s["outliers"], s["outliers_z"] = hits.get(f"{c}|iqr", 0), hits.get(f"{c}|z", 0)
    return out


def column_kinds(df: DataFrame) -> dict[str, str]:
    """numeric, datetime or categorical per column; text counts by the share of rows that parse."""
    texts = text_columns(df)
    shares = {}
    if texts:
        exprs = {}
        for c in texts:
            col = quoted(c)
            # most text starts like neither, and a failed parse costs far more than the look at its start
            number = F.when(col.rlike(NUMBER_START), col.try_cast("double"))
            date = F.when(col.rlike(DATE_START), F.try_to_timestamp(col))
            exprs[f"{c}|n"] = F.avg(number.isNotNull().cast("double"))
            exprs[f"{c}|d"] = F.avg(date.isNotNull().cast("double"))
        shares = wide.fetch(df, exprs)
    kinds = {}
    for f in df.schema:
        if is_numeric(f.dataType) or (shares.get(f"{f.name}|n") or 0) >= NUMBER_SHARE:
            kinds[f.name] = "numeric"
        elif is_date(f.dataType) or (shares.get(f"{f.name}|d") or 0) >= DATE_SHARE:
            kinds[f.name] = "datetime"
        else:
            kinds[f.name] = "categorical"
    return kinds


def _null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    got = wide.fetch(df, {"": F.count("*"), **{c: F.count_if(known(df, c).isNull()) for c in df.columns}})
    return got.pop(""), got


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, kind, missing cells, and moments with outliers or the number of distinct values."""
    kinds = column_kinds(df)
    numbers = numeric_summary(df)
    others = [c for c in df.columns if c not in numbers]
    unique = distinct_counts(df, others)
    _, missing = _null_counts(df)
    two = lambda v: None if v is None else float(v)
    rows = []
    for c in df.columns:
        s = numbers.get(c, {})
        rows.append(
            (c, df.schema[c].dataType.simpleString(), kinds[c], missing[c])
            + tuple(two(s.get(k)) for k in ("mean", "median", "min", "max", "std"))
            + (s.get("outliers"), unique.get(c))
        )
    frame = wide.rows_frame(
        df.sparkSession,
        rows,
        "column_name string, dtype string, kind string, missing bigint, mean double, median double, "
        "min double, max double, std double, outliers bigint, unique_values bigint",
    )
    return frame.withColumns({c: rounded(F.col(c), 2) for c in ("mean", "median", "min", "max", "std")})


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5, max_distinct: int = 20) -> DataFrame:
    """The ``n`` most frequent values of each column that has fewer than ``max_distinct`` of them."""
    few = [c for c, d in distinct_counts(df, columns).items() if 0 < d < max_distinct]
    if not few:
        return wide.rows_frame(df.sparkSession, [], "column_name string, value string, cnt bigint, position int")
    order = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("value"))
    return (
        value_counts(df, few)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
    )


def profile_result(df: DataFrame) -> DataFrame:
    """Profile of a query result: nulls, distinct values, extremes as text, mean, median and deviation."""
    ends = wide.fetch(
        df,
        {
            "rows": F.count("*"),
            **{
                f"{c}|{name}": make(known(df, c))
                for c in df.columns
                for name, make in (
                    ("known", F.count),
                    ("min", lambda v: F.min(v).cast("string")),
                    ("max", lambda v: F.max(v).cast("string")),
                )
            },
        },
    )
    total = ends["rows"]
    missing = {c: total - ends[f"{c}|known"] for c in df.columns}
    unique = distinct_counts(df, df.columns)
    numbers = numeric_summary(df, outliers=False)
    rows = []
    for c in df.columns:
        s = numbers.get(c, {})
        rows.append(
            (c, df.schema[c].dataType.simpleString(), missing[c], missing[c] / max(total, 1) * 100)
            + (unique[c], unique[c] / max(total, 1) * 100, total - unique[c], ends[f"{c}|min"], ends[f"{c}|max"])
            + tuple(s.get(k) for k in ("mean", "median", "std"))
        )
    frame = wide.rows_frame(
        df.sparkSession,
        rows,
        "column_name string, dtype string, null_count bigint, null_pct double, unique_count bigint, "
        "unique_pct double, duplicate_count bigint, min_value string, max_value string, "
        "mean_value double, median_value double, std_value double",
    )
    two, four = ("null_pct", "unique_pct"), ("mean_value", "median_value", "std_value")
    return frame.withColumns({**{c: rounded(F.col(c), 2) for c in two}, **{c: rounded(F.col(c), 4) for c in four}})


def result_summary(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows, missing cells and cells of a query result."""
    cells = F.sum(sum((known(df, c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint")) * F.col("_n"))
    return _grouped_rows(df).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(cells, F.lit(0)).alias("missing_cells"),
        (F.coalesce(F.sum("_n"), F.lit(0)) * len(df.columns)).alias("total_cells"),
    )


def _grouped_rows(df: DataFrame) -> DataFrame:
    """Distinct rows with their multiplicity; copies are folded before the shuffle."""
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_n"))


def _severity(pct: Column, medium: float, high: float) -> Column:
    return F.when(pct < medium, "low").when(pct < high, "medium").otherwise("high")


def missing_report(df: DataFrame) -> DataFrame:
    """Missing cells and share per column with any, next to the share over all cells and its severity."""
    total, missing = _null_counts(df)
    holes = sum(missing.values())
    frame = wide.rows_frame(
        df.sparkSession,
        [(c, n, n / max(total, 1) * 100, holes, holes / max(total * len(df.columns), 1) * 100) for c, n in missing.items() if n],
        "column_name string, missing bigint, missing_pct double, total_missing bigint, total_pct double",
    )
    frame = frame.withColumns({c: rounded(F.col(c), 2) for c in ("missing_pct", "total_pct")})
    return frame.withColumn("severity", _severity(F.col("total_pct"), 5, 20)).orderBy(F.desc("missing"), "column_name")


def duplicate_twins(df: DataFrame) -> DataFrame:
    """How many rows have an identical twin, and their share."""
    return _grouped_rows(df).agg(
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("duplicate_rows"),
        rounded(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)) / F.sum("_n") * 100, 2).alias("pct"),
    )


def duplicate_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct rows, in column order, that occur more than once."""
    return _grouped_rows(df).where(F.col("_n") > 1).withColumnRenamed("_n", "copies").orderBy(*df.columns).limit(n)


def duplicate_extras(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows, their share and severity."""
    pct = rounded(F.sum(F.col("_n") - 1) / F.sum("_n") * 100, 2)
    out = _grouped_rows(df).agg(F.sum(F.col("_n") - 1).alias("extra_rows"), pct.alias("pct"))
    return out.withColumn("severity", _severity(F.col("pct"), 1, 10))


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, fences and outlier counts (IQR and z-score) per numeric column."""
    keys = ("min", "q1", "median", "q3", "max", "iqr", "lower", "upper")
    rows = [
        (c, *[float(s[k]) for k in keys], s["outliers"], s["outliers_z"], s["outliers"] / s["rows"] * 100)
        for c, s in numeric_summary(df, columns).items()
        if s["n"]
    ]
    frame = wide.rows_frame(
        df.sparkSession,
        rows,
        "column_name string, " + ", ".join(f"{k} double" for k in keys) + ", outliers_iqr bigint, outliers_zscore bigint, outlier_pct double",
    )
    return frame.withColumns({**{k: rounded(F.col(k), 4) for k in keys}, "outlier_pct": rounded(F.col("outlier_pct"), 2)})


def outlier_summary(df: DataFrame) -> DataFrame:
    """Outliers per numeric column that has at least four values and a spread, with the mean share."""
    rows = [
        (c, s["outliers"], s["outliers"] / s["n"] * 100, s["lower"], s["upper"])
        for c, s in numeric_summary(df).items()
        if s["n"] >= 4 and s["iqr"]
    ]
    frame = wide.rows_frame(
        df.sparkSession, rows, "column_name string, outliers bigint, pct double, lower_bound double, upper_bound double"
    )
    frame = frame.withColumns({c: rounded(F.col(c), 2) for c in ("pct", "lower_bound", "upper_bound")})
    # one row per column here, so a window over all of them is small
    everything = Window.partitionBy(F.lit(0))
    return frame.withColumn("mean_pct", rounded(F.avg("pct").over(everything), 2)).orderBy(F.desc("outliers"), "column_name")


def encoding_candidates(df: DataFrame) -> DataFrame:
    """Categorical columns with 2 to 100 distinct values and the encoding that fits them."""
    kinds = column_kinds(df)
    columns = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.StringType, T.BooleanType)) and kinds[f.name] != "datetime"
    ]
    unique = distinct_counts(df, columns)
    rows = [(c, n, "one_hot" if n <= 20 else "label") for c, n in unique.items() if 1 < n <= 100]
    return wide.rows_frame(df.sparkSession, rows, "column_name string, unique_values bigint, recommended string")


def scaling_candidates(df: DataFrame) -> DataFrame:
    """Range, moments, median and IQR per numeric column, and whether it is constant."""
    keys = ("min", "max", "mean", "std", "median", "iqr")
    rows = [
        (c, *[None if s[k] is None else float(s[k]) for k in keys], s["min"] == s["max"])
        for c, s in numeric_summary(df, outliers=False).items()
        if s["n"]
    ]
    frame = wide.rows_frame(
        df.sparkSession, rows, "column_name string, " + ", ".join(f"{k} double" for k in keys) + ", constant boolean"
    )
    return frame.withColumns({k: rounded(F.col(k), 4) for k in keys})


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are known (one scan)."""
    columns = numeric_columns(df) if columns is None else list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = wide.fetch(
        df, {f"{a}|{b}": F.corr(known(df, a).cast("double"), known(df, b).cast("double")) for a, b in pairs}
    )
    rows = [(a, b, got[f"{a}|{b}"]) for a, b in pairs if got[f"{a}|{b}"] is not None]
    frame = wide.rows_frame(df.sparkSession, rows, "x string, y string, r double")
    return frame.withColumn("r", rounded(F.col("r"), 3))


def top_correlations(df: DataFrame, n: int = 20) -> DataFrame:
    return correlations(df).orderBy(F.desc(F.abs("r")), "x", "y").limit(n)


def unbiased_skewness(value: Column) -> Column:
    """Adjusted Fisher-Pearson coefficient."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Counts per equal-width bin from minimum to maximum, empty bins kept, the last bin closed.

    Without ``bins`` the width is the smaller of Sturges' and the IQR rule, the latter held at or above
    range / (2 * sqrt(n)); whole-numbered data get no bin narrower than one.
    """
    value = known(df, column)
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    s = wide.fetch(df, {"n": F.count(value), "min": F.min(value).cast("double"), "max": F.max(value).cast("double")})
    n, low, high = s["n"], s["min"], s["max"]
    if not n:
        raise ValueError(f"column {column!r} has no values")
    if bins is None:
        bins = _automatic_bins(df, value, n, low, high, whole)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    position = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(position.alias("bin")).agg(F.count("*").alias("cnt"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        rounded(F.lit(low) + F.col("bin") * F.lit(width), 4).alias("bin_start"),
        rounded(F.lit(low) + (F.col("bin") + 1) * F.lit(width), 4).alias("bin_end"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
    )


def _automatic_bins(df: DataFrame, value: Column, n: int, low: float, high: float, whole: bool) -> int:
    import math

    spread = high - low
    if spread == 0:
        return 1
    q1, q3 = quantiles(df, {"v": (value, [0.25, 0.75])}, {"v": n})["v"]
    width = spread / (math.log2(n) + 1)
    if q3 > q1:
        width = min(width, max(2 * (q3 - q1) / n ** (1 / 3), spread / (2 * math.sqrt(n))))
    if whole:
        width = max(width, 1.0)
    return math.ceil(spread / width)


def feature_roles(df: DataFrame) -> DataFrame:
    """numeric, categorical, text, datetime, boolean or id per column."""
    unique = distinct_counts(df, df.columns)
    filled = wide.fetch(df, {c: F.count(known(df, c)) for c in df.columns})
    texts = text_columns(df)
    length = wide.fetch(df, {c: F.avg(F.length(quoted(c))) for c in texts}) if texts else {}

    def role(field: T.StructField) -> str:
        name, n = field.name, unique[field.name]
        if filled[name] == 0:
            return "categorical"
        if is_date(field.dataType):
            return "datetime"
        if isinstance(field.dataType, T.BooleanType) or n == 2:
            return "boolean"
        if is_numeric(field.dataType):
            if n == filled[name] and "id" in name.lower():
                return "id"
            return "categorical" if n <= 10 else "numeric"
        if name in length and n > 30 and length[name] > 50:
            return "text"
        return "categorical"

    rows = [(f.name, role(f), unique[f.name]) for f in df.schema]
    return wide.rows_frame(df.sparkSession, rows, "column_name string, role string, unique_values bigint")


def class_share(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class of the rows with a known class."""
    total = df.agg(F.count(known(df, target))).first()[0]
    counts = df.where(known(df, target).isNotNull()).groupBy(quoted(target).alias("label")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("pct", rounded(F.col("cnt") / F.lit(max(total, 1)) * 100, 2))


def class_imbalance(df: DataFrame, target: str, max_classes: int | None = None) -> DataFrame:
    """Largest over smallest class share and its severity; no row beyond ``max_classes``, if given."""
    ratio = rounded(F.when(F.min("pct") > 0, F.max("pct") / F.min("pct")).otherwise(99.0), 2)
    out = class_share(df, target).agg(F.count("*").alias("classes"), ratio.alias("imbalance_ratio"))
    out = out if max_classes is None else out.where(F.col("classes") <= max_classes)
    return out.withColumn("severity", _severity(F.col("imbalance_ratio"), 2, 5))


def quality_score(df: DataFrame, target: str | None = None) -> DataFrame:
    """Mean of the missing, duplicate, outlier and class-balance scores, with a grade."""
    total, missing = _null_counts(df)
    missing_pct = F.lit(sum(missing.values()) / max(total * len(df.columns), 1) * 100)
    dup = duplicate_extras(df).select(F.col("pct").alias("dup_pct"))
    spread = [s for s in numeric_summary(df).values() if s["n"] >= 4 and s["iqr"]]
    shares = [F.round(F.lit(s["outliers"] / s["n"] * 100), 2) for s in spread]
    outlier_pct = F.round(sum(shares) / len(shares), 2) if shares else F.lit(0.0)
    balance = F.lit(100.0)
    if target is not None:
        found = class_imbalance(df, target).first()
        balance = F.lit({"high": 60.0, "medium": 80.0}.get(found["severity"] if found else "", 100.0))
    at_least_zero = lambda c: F.greatest(F.lit(0.0), c)
    parts = dup.select(
        at_least_zero(100 - F.round(missing_pct, 2) * 2).alias("missing_data"),
        at_least_zero(100 - F.col("dup_pct") * 5).alias("duplicates"),
        at_least_zero(100 - outlier_pct * 2).alias("outliers"),
        balance.alias("class_balance"),
    )
    names = ("missing_data", "duplicates", "outliers", "class_balance")
    scored = parts.withColumn("total", rounded(sum(F.col(n) for n in names) / 4, 1))
    scored = scored.withColumns({n: rounded(F.col(n), 1) for n in names})
    return scored.withColumn("grade", grade(F.col("total")))


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")
    )


def column_quality(df: DataFrame) -> DataFrame:
    """100 minus two points per percent of missing cells and of outliers, per column."""
    total, missing = _null_counts(df)
    numbers = numeric_summary(df)
    rows = [
        (c, missing[c] / total * 100, numbers[c]["outliers"] / total * 100 if c in numbers else 0.0) for c in df.columns
    ]
    frame = wide.rows_frame(df.sparkSession, rows, "column_name string, missing_pct double, outlier_pct double")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 2 * F.col("missing_pct") - 2 * F.col("outlier_pct"))))
    return frame.select("column_name", score.cast("bigint").alias("score"), grade(score).alias("grade"))


def missing_matrix(df: DataFrame, order_by: Sequence[str], n: int = 30) -> DataFrame:
    """Which cells of the first ``n`` rows are null or empty."""
    flags = [
        (known(df, c).isNull() | (quoted(c).cast("string") == "")).alias(c) if c not in order_by else quoted(c)
        for c in df.columns
    ]
    return df.orderBy(*order_by).limit(n).select(*flags)


ID_NAME = re.compile(r"(^id$|_id$|\.id$|^index$)")


def leakage_warnings(df: DataFrame, target: str, limit: float = 0.95) -> DataFrame:
    """Columns nearly equal to the target (by correlation) and columns that look like identifiers."""
    others = [c for c in numeric_columns(df) if c != target]
    got = wide.fetch(df, {c: F.corr(known(df, c).cast("double"), known(df, target).cast("double")) for c in others})
    rows = [(c, "target_leakage", round(r, 3)) for c, r in got.items() if r is not None and abs(r) > limit]
    total = df.count()
    unique = distinct_counts(df, [c for c in df.columns if c != target])
    rows += [(c, "identifier", None) for c, n in unique.items() if ID_NAME.search(c.lower()) or n == total]
    return wide.rows_frame(df.sparkSession, rows, "column_name string, warning string, r double")


def cleaning_recommendations(df: DataFrame, target: str | None = None) -> DataFrame:
    """Advised cleaning actions with priority and the number of columns or rows concerned."""
    total, missing = _null_counts(df)
    missing_pct = sum(missing.values()) / max(total * len(df.columns), 1) * 100
    rows = []
    if sum(missing.values()):
        rows.append(("impute_missing", "high" if missing_pct > 10 else "medium", sum(missing.values())))
    dup = duplicate_extras(df).first()
    if dup["extra_rows"]:
        rows.append(("remove_duplicates", "high" if dup["pct"] > 5 else "low", dup["extra_rows"]))
    spread = [s for s in numeric_summary(df).values() if s["n"] >= 4 and s["iqr"]]
    wild = [s for s in spread if s["outliers"] / s["n"] * 100 > 5]
    if wild:
        rows.append(("remove_outliers", "medium", len(wild)))
    roles = {r["column_name"]: r["role"] for r in feature_roles(df).collect()}
    classes = [c for c, r in roles.items() if r == "categorical" and c != target]
    if classes:
        rows.append(("encode_categorical", "medium", len(classes)))
    if target and isinstance(df.schema[target].dataType, T.StringType):
        rows.append(("encode_target", "high", 1))
    if target:
        balance = class_imbalance(df, target).first()
        if balance and balance["severity"] in ("medium", "high"):
            rows.append(("handle_imbalance", "high", balance["classes"]))
    if numeric_columns(df):
        rows.append(("scale_numeric", "low", len(numeric_columns(df))))
    return wide.rows_frame(df.sparkSession, rows, "action string, priority string, concerned bigint")


def result_hints(df: DataFrame, large: int = 100_000, interacting: int | None = None, correlated: int | None = None) -> DataFrame:
    """Hints about a query result: gaps, near-unique and constant columns, copies, size, dates, encodings.

    ``interacting`` and ``correlated`` name that many of the first numeric columns only; by default all.
    """
    total, missing = _null_counts(df)
    unique = distinct_counts(df, df.columns)
    pct = lambda n: n / max(total, 1) * 100
    numbers = [f.name for f in df.schema if is_numeric(f.dataType)]
    texts = text_columns(df)
    dates = [f.name for f in df.schema if is_date(f.dataType)]
    copies = duplicate_extras(df).first()["extra_rows"]
    rules = [
        ("high_missing", [c for c in df.columns if pct(missing[c]) > 30]),
        ("target_candidates", [c for c in numbers if unique[c] > 2 and pct(missing[c]) < 50]),
        ("high_cardinality", [c for c in df.columns if pct(unique[c]) > 90 and pct(missing[c]) < 50]),
        ("interactions", numbers[:interacting] if len(numbers) > 2 else []),
        ("large_result", ["*"] if total > large else []),
        ("duplicate_rows", ["*"] if copies else []),
        ("constant_columns", [c for c in df.columns if unique[c] <= 1]),
        ("encode_text", texts if numbers else []),
        ("date_parts", dates if numbers else []),
        ("check_outliers", [c for c in numbers if pct(missing[c]) < 50]),
        ("check_correlation", numbers[:correlated] if len(numbers) >= 2 else []),
    ]
    rows = [(name, ",".join(columns)) for name, columns in rules if columns] or [("clean", "*")]
    return wide.rows_frame(df.sparkSession, rows, "hint string, columns string")
