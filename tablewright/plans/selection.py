"""Exact order statistics of columns of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, so it is used only where the
number of rows is known to be small.  Larger columns are narrowed first: a quantile sketch proposes a bracket
around each wanted rank, one counting scan proves on which side of the bracket ends the rank lies, and only
the open interval between the ends is looked at again.  Every step is a scan with map-side aggregation for
all columns together; nothing that grows with the data is collected, and hot values end the search at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from tablewright.plans import wide

EXACT_ROWS = 100_000
SKETCH_ACCURACY = 2_000
_MAX_ROUNDS = 12


@dataclass
class _Search:
    column: str
    rank: int  # zero-based among the non-null values
    low: object = None  # open interval still in question; None = unbounded
    high: object = None
    below: int = 0  # values left of the interval
    size: int = 0  # values inside the interval
    value: object = None
    done: bool = False

    def inside(self) -> Column:
        x = F.col(self.column)
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > F.lit(self.low))
        if self.high is not None:
            cond = cond & (x < F.lit(self.high))
        return F.when(cond, x)


def _small(data: DataFrame, searches: list[_Search]) -> None:
    # searches in the same interval of a column share one buffer of its values
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault((s.column, s.low, s.high), []).append(s)
    groups = list(shared.values())
    frame = data.select(*[g[0].inside().alias(f"c{i}") for i, g in enumerate(groups)])
    exprs = {}
    for i, group in enumerate(groups):
        places = ", ".join(f"{(s.rank - s.below + 0.5) / s.size!r}D" for s in group)
        exprs[str(i)] = F.expr(f"percentile_disc(array({places})) WITHIN GROUP (ORDER BY c{i})")
    got = wide.fetch(frame, exprs)
    for i, group in enumerate(groups):
        whole = isinstance(frame.schema[f"c{i}"].dataType, IntegralType)
        for s, value in zip(group, got[str(i)]):
            s.value, s.done = int(value) if whole else value, True


def _narrow(data: DataFrame, searches: list[_Search]) -> None:
    # searches that still look at the same interval share one sketch
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(searches):
        shared.setdefault((s.column, s.low, s.high), []).append(i)
    exprs, ends = {}, {}
    for group, members in shared.items():
        points = set()
        for i in members:
            s = searches[i]
            p = (s.rank - s.below + 0.5) / s.size
            ends[i] = (max(0.0, p - 4 / SKETCH_ACCURACY), min(1.0, p + 4 / SKETCH_ACCURACY))
            points.update(ends[i])
        exprs[str(members[0])] = F.percentile_approx(searches[members[0]].inside(), sorted(points), SKETCH_ACCURACY)
        shared[group] = [*members, sorted(points)]
    sketches = wide.fetch(data, exprs)
    brackets = {}
    for *members, points in shared.values():
        at = dict(zip(points, sketches[str(members[0])]))
        brackets.update({str(i): (at[ends[i][0]], at[ends[i][1]]) for i in members})
    counts = {}
    for i, s in enumerate(searches):
        x, (a, b) = s.inside(), brackets[str(i)]
        for name, cond in (("lt_a", x < F.lit(a)), ("le_a", x <= F.lit(a)), ("lt_b", x < F.lit(b)), ("le_b", x <= F.lit(b))):
            counts[f"{i}{name}"] = F.count_if(cond)
    got = wide.fetch(data, counts)
    for i, s in enumerate(searches):
        a, b = brackets[str(i)]
        lt_a, le_a, lt_b, le_b = (s.below + got[f"{i}{n}"] for n in ("lt_a", "le_a", "lt_b", "le_b"))
        if s.rank < lt_a:
            s.high, s.size = a, lt_a - s.below
        elif s.rank < le_a:
            s.value, s.done = a, True
        elif s.rank < lt_b:
            s.low, s.high, s.below, s.size = a, b, le_a, lt_b - le_a
        elif s.rank < le_b:
            s.value, s.done = b, True
        else:
            s.low, s.size = b, s.size - (le_b - s.below)
            s.below = le_b


def order_statistics(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[int]]], counts: Mapping[str, int] | None = None) -> dict[str, list]:
    """Values at the given zero-based ranks of each column (nulls excluded), in the order of the ranks."""
    names = list(wanted)
    data = df.select(*[wanted[n][0].alias(f"v{i}") for i, n in enumerate(names)])
    if counts is None:
        counts = wide.fetch(data, {n: F.count(F.col(f"v{i}")) for i, n in enumerate(names)})
    plan = {n: [_Search(f"v{i}", int(r), size=counts[n]) for r in wanted[n][1]] for i, n in enumerate(names)}
    open_ = [s for group in plan.values() for s in group]
    for s in open_:
        if s.size == 0:
            s.done = True
        elif not 0 <= s.rank < s.size:
            raise ValueError(f"rank {s.rank} outside a column of {s.size} values")
    for _ in range(_MAX_ROUNDS):
        open_ = [s for s in open_ if not s.done]
        small = [s for s in open_ if s.size <= EXACT_ROWS]
        if small:
            _small(data, small)
        large = [s for s in open_ if s.size > EXACT_ROWS]
        if not large:
            break
        _narrow(data, large)
    if any(not s.done for group in plan.values() for s in group):
        raise RuntimeError("order statistic search did not converge")
    return {n: [s.value for s in group] for n, group in plan.items()}


def quantiles(
    df: DataFrame,
    wanted: Mapping[str, tuple[Column, Sequence[float]]],
    counts: Mapping[str, int] | None = None,
    at_most: int | None = None,
) -> dict[str, list]:
    """Exact quantiles with linear interpolation; ``None`` for a column without values.

    ``counts`` are the known numbers of values, ``at_most`` a known bound of the rows; either saves a scan.
    """
    names = list(wanted)
    if at_most is not None and at_most <= EXACT_ROWS:
        got = wide.fetch(df, {n: F.percentile(wanted[n][0].cast("double"), list(wanted[n][1])) for n in names})
        return {n: got[n] if got[n] is not None else [None] * len(wanted[n][1]) for n in names}
    if counts is None:
        data = df.select(*[wanted[n][0].alias(f"v{i}") for i, n in enumerate(names)])
        counts = wide.fetch(data, {n: F.count(F.col(f"v{i}")) for i, n in enumerate(names)})
    small = [n for n in names if counts[n] <= EXACT_ROWS]
    out: dict[str, list] = {n: [None] * len(wanted[n][1]) for n in names}
    if small:
        got = wide.fetch(df, {n: F.percentile(wanted[n][0].cast("double"), list(wanted[n][1])) for n in small})
        out.update({n: got[n] for n in small if counts[n]})
    large = [n for n in names if n not in small]
    if large:
        spots = {n: [q * (counts[n] - 1) for q in wanted[n][1]] for n in large}
        ranks = {n: sorted({f(p) for p in spots[n] for f in (math.floor, math.ceil)}) for n in large}
        got = order_statistics(df, {n: (wanted[n][0], ranks[n]) for n in large}, counts)
        for n in large:
            at = dict(zip(ranks[n], (float(v) for v in got[n])))
            out[n] = [
                at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in spots[n]
            ]
    return out


def first_rows_bound(df: DataFrame, order: Sequence[Column], k: int, rows: int | None = None) -> Column:
    """Condition that holds for exactly the first ``k`` rows in the given (unique, non-null) order.

    The bound is found column by column: the value at rank ``k`` of the first column, then the rank that is
    left among the rows sharing that value, and so on, so no global sort takes place.  ``rows`` is the number of
    rows if known.
    """
    if k <= 0:
        return F.lit(False)
    condition, tied, rest = None, F.lit(True), k - 1
    pieces: list[Column] = []
    for col in order:
        scope = df.where(tied)
        value = order_statistics(scope, {"x": (col, [rest])}, None if rows is None else {"x": rows})["x"][0]
        rows = None
        pieces.append(tied & (col < F.lit(value)))
        below, same = scope.agg(F.count_if(col < F.lit(value)), F.count_if(col == F.lit(value))).first()
        rest -= below
        tied = tied & (col == F.lit(value))
        if rest == same - 1:
            pieces.append(tied)
            break
    else:
        pieces.append(tied)
    for piece in pieces:
        condition = piece if condition is None else condition | piece
    return condition
