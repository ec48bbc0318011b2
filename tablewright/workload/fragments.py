"""Table expressions shared by queries and their DuckDB texts (valid in both engines)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

# lineitem with natural gaps (zero discount, zero tax and flag N read as unknown); without keys, so rows repeat
ITEMS = """
SELECT l_quantity AS quantity, l_extendedprice AS price, NULLIF(l_discount, 0) AS discount,
       NULLIF(l_tax, 0) AS tax, NULLIF(l_returnflag, 'N') AS flag, l_linestatus AS status, l_linenumber AS line
FROM lineitem
"""

# the same without the price: many identical rows
SHORT_ITEMS = """
SELECT l_quantity AS quantity, NULLIF(l_discount, 0) AS discount, NULLIF(l_tax, 0) AS tax,
       NULLIF(l_returnflag, 'N') AS flag, l_linestatus AS status
FROM lineitem
"""

# skewed numbers: event values with a long tail
EVENT_VALUES = "SELECT event_id, user_id, event_type, value, value * value AS squared FROM events"

ITEM_NUMBERS = {"quantity": "double", "price": "double", "discount": "double", "tax": "double", "line": "int"}
ITEM_TYPES = {
    "quantity": "double",
    "price": "double",
    "discount": "double",
    "tax": "double",
    "flag": "string",
    "status": "string",
    "line": "int",
}
SHORT_NUMBERS = ["quantity", "discount", "tax"]
SHORT_COLUMNS = ["quantity", "discount", "tax", "flag", "status"]


def union(parts: Iterable[str]) -> str:
    return "\nUNION ALL ".join(parts)


def per_column(columns: Iterable[str], make: Callable[[str], str]) -> str:
    return union(make(c) for c in columns)


def r(expr: str, digits: int = 6) -> str:
    """DuckDB text of ``rounded``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def fences(source: str, column: str) -> str:
    """DuckDB subquery with the quartiles and fences of one column of a CTE."""
    return f"""(SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM
      (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS med, quantile_cont({column}, 0.75) AS q3,
              avg({column}) AS mean, stddev_samp({column}) AS std, min({column}) AS lo, max({column}) AS hi FROM {source}))"""
