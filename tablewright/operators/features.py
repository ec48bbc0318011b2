"""Feature engineering.  Touched columns get their gaps filled with the median first, others keep theirs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.plans import wide
from tablewright.plans.selection import quantiles
from tablewright.plans.types import is_numeric, known, numeric_columns, quoted


class FeatureError(ValueError):
    """No feature could be generated."""


def _usable(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric columns of the request, and a warning for every other one."""
    good, warnings = [], []
    for c in columns:
        if c not in df.columns:
            warnings.append(f"unknown column {c}")
        elif not is_numeric(df.schema[c].dataType):
            warnings.append(f"column {c} is not numeric")
        else:
            good.append(c)
    return good, warnings


def _fill_medians(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    holes = wide.fetch(df, {c: F.count_if(known(df, c).isNull()) for c in columns})
    missing = [c for c in columns if holes[c]]
    if not missing:
        return df, []
    medians = quantiles(df, {c: (known(df, c), [0.5]) for c in missing})
    filled = {c: F.coalesce(known(df, c).cast("double"), F.lit(medians[c][0] if medians[c][0] is not None else 0.0)) for c in missing}
    return df.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns]), missing


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> dict[str, Column]:
    """All monomials up to the degree (``a^2``, ``a b``); of a single column its powers."""
    if len(columns) == 1:
        return {f"{columns[0]}^{d}": F.pow(quoted(columns[0]).cast("double"), F.lit(d)) for d in range(2, degree + 1)}
    out = {}
    for d in range(1, degree + 1):
        for term in combinations_with_replacement(columns, d):
            parts = [(c, term.count(c)) for c in dict.fromkeys(term)]
            name = " ".join(c if n == 1 else f"{c}^{n}" for c, n in parts)
            value = F.lit(1.0)
            for c, n in parts:
                for _ in range(n):
                    value = value * quoted(c)
            if name not in df.columns:
                out[name] = value
    return out


def interactions(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{a}_x_{b}": quoted(a) * quoted(b) for a, b in combinations(columns, 2)}


def equal_width_bins(df: DataFrame, columns: Sequence[str], n: int = 5) -> dict[str, Column]:
    """Code 0..n-1 of right-closed bins of equal width; a constant column falls in the middle."""
    ends = wide.fetch(df, {f"{k}|{c}": f(known(df, c)).cast("double") for c in columns for k, f in (("a", F.min), ("b", F.max))})
    out = {}
    for c in columns:
        low, high = ends[f"a|{c}"], ends[f"b|{c}"]
        if low is None:
            out[f"{c}_binned"] = F.lit(None).cast("int")
            continue
        if low == high:
            spread = 0.001 * abs(low) if low else 0.001
            low, high = low - spread, high + spread
        width = (high - low) / n
        place = F.ceil((quoted(c) - F.lit(low)) / F.lit(width)) - 1
        inside = F.greatest(F.lit(0), F.least(F.lit(n - 1), place))
        out[f"{c}_binned"] = F.when(quoted(c).isNotNull(), inside).cast("int")
    return out


def quantile_bins(df: DataFrame, columns: Sequence[str], n: int = 4) -> dict[str, Column]:
    """Code 0..n-1 of right-closed bins between exact quantiles."""
    cuts = quantiles(df, {c: (known(df, c), [i / n for i in range(1, n)]) for c in columns})
    out = {}
    for c in columns:
        above = sum(((quoted(c) > F.lit(v)).cast("int") for v in cuts[c] if v is not None), F.lit(0))
        out[f"{c}_qbin"] = F.when(quoted(c).isNotNull(), above)
    return out


def logs(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """log1p; a column with values at or below zero is shifted to start at 1 first."""
    ends = wide.fetch(df, {c: F.min(known(df, c)).cast("double") for c in columns})
    out = {}
    for c in columns:
        value = quoted(c).cast("double")
        if ends[c] is not None and ends[c] <= 0:
            value = value - F.lit(ends[c]) + 1.0
        out[f"log_{c}"] = F.log1p(value)
    return out


def roots(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Square roots of the columns without negative values."""
    ends = wide.fetch(df, {c: F.min(known(df, c)).cast("double") for c in columns})
    return {f"sqrt_{c}": F.sqrt(quoted(c).cast("double")) for c in columns if ends[c] is None or ends[c] >= 0}


def ratio(a: str, b: str) -> dict[str, Column]:
    """a / b, null where b is zero."""
    return {f"{a}_per_{b}": F.try_divide(quoted(a).cast("double"), quoted(b).cast("double"))}


def engineer(df: DataFrame, operations: Sequence[Mapping]) -> tuple[DataFrame, dict]:
    """Apply polynomial, interaction, bin, log, sqrt, ratio and quantile_bin operations in order.

    Raises :class:`FeatureError` when nothing at all was generated.
    """
    out, generated, warnings = df, [], []
    for op in operations:
        kind = op["type"]
        columns = op.get("columns", [])
        good, notes = _usable(out, [columns] if isinstance(columns, str) else columns)
        warnings += notes
        if not good:
            warnings.append(f"{kind}: no usable numeric column")
            continue
        out, filled = _fill_medians(out, good)
        if filled:
            warnings.append(f"{kind}: filled {', '.join(filled)} with the median")
        if kind == "polynomial":
            new = polynomial(out, good, op.get("degree", 2))
        elif kind == "interaction":
            new = interactions(good)
        elif kind == "bin":
            new = equal_width_bins(out, good, op.get("n_bins", 5))
        elif kind == "quantile_bin":
            new = quantile_bins(out, good, op.get("n_bins", 4))
        elif kind == "log":
            new = logs(out, good)
        elif kind == "sqrt":
            new = roots(out, good)
            warnings += [f"sqrt: {c} has negative values" for c in good if f"sqrt_{c}" not in new]
        elif kind == "ratio":
            new = ratio(*good[:2]) if len(good) > 1 else {}
        else:
            warnings.append(f"unknown operation {kind}")
            continue
        out = out.withColumns(new) if new else out
        generated += list(new)
    if not generated:
        raise FeatureError("no features were generated: " + "; ".join(warnings))
    return out, {"generated": [c for c in out.columns if c not in df.columns], "warnings": warnings}


def suggest(df: DataFrame) -> DataFrame:
    """Operations worth trying: rows (type, columns)."""
    numbers = numeric_columns(df)
    rows = []
    if len(numbers) >= 2:
        rows += [("polynomial", ",".join(numbers[:3])), ("interaction", ",".join(numbers[:3]))]
    tried = numbers[:2]
    # a gap fails the test for positive values, as a comparison with a missing cell does
    ends = wide.fetch(df, {f"{k}|{c}": f for c in tried for k, f in (("p", F.bool_and(F.coalesce(known(df, c) > 0, F.lit(False)))), ("z", F.bool_and(F.coalesce(known(df, c) >= 0, F.lit(False)))))}) if tried else {}
    for c in tried:
        if ends[f"p|{c}"]:
            rows.append(("log", c))
        if ends[f"z|{c}"]:
            rows.append(("sqrt", c))
        rows.append(("bin", c))
    return wide.rows_frame(df.sparkSession, rows, "type string, columns string")
