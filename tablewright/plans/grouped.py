"""Exact order statistics inside every group of a table at once, whatever the number and the sizes of the groups.

Values are whole numbers of ``BITS`` bits. A scan counts the next ``RADIX`` bits of the values of every group that is still
too large, and the bucket that holds the wanted rank is kept; all groups are narrowed in the same scan. Buckets of at
most ``GROUP_ROWS`` rows are put in order, with the keys deciding between equal values. Ranks, buckets and cuts are tables:
nothing about a group reaches the driver, and no expression grows with their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.plans.durable import durable
from tablewright.plans.ordered import join_back
from tablewright.plans.types import known, quoted

BITS, RADIX = 52, 13
GROUP_ROWS = 100_000


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """Rows (_g, _size) of the known values of a column, written once."""
    return durable(df.where(known(df, column).isNotNull()).groupBy(quoted(column).alias("_g")).agg(F.count("*").alias("_size")))


def entry(place: Column, keys: Sequence[str]) -> Column:
    """What rows of a group are ordered by: the value, then the keys."""
    return F.struct(place.alias("_place"), *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)])


def _prefix(bits: int) -> Column:
    return F.shiftright(F.col("_entry")["_place"], BITS - bits)


def _inside(rows: DataFrame, open_: DataFrame, bits: int) -> DataFrame:
    """The rows of the buckets in question."""
    buckets = open_.groupBy("_g", "_prefix").agg(F.max("_size").alias("_size"))
    return join_back(rows.withColumn("_prefix", _prefix(bits)), buckets, ["_g", "_prefix"], "_size")


def _at_rank(open_: DataFrame, counted: DataFrame, order: str) -> DataFrame:
    """Per wanted rank the counted row (n rows each) that holds it, and how many rows of the bucket lie before."""
    before = Window.partitionBy("_g", "_prefix").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = open_.join(upto, ["_g", "_prefix"])
    return found.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))


def grouped_cuts(df: DataFrame, group: str, place: Column, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """(_g, _size, _cuts): the entries at the wanted ranks of every group, ascending.

    ``wanted`` has (_g, _rank from 0, _size of the group), ``place`` is a number of ``BITS`` bits. Rows with equal place and
    keys count one by one and share an entry.
    """
    rows = df.where(known(df, group).isNotNull()).select(quoted(group).alias("_g"), entry(place, keys).alias("_entry"))
    open_ = durable(wanted.select("_g", F.col("_rank").cast("bigint"), F.lit(0).cast("bigint").alias("_prefix"), "_size"))
    wanted = wanted.groupBy("_g").agg(F.max("_size").alias("_size"))
    ready, bits = [], 0
    while bits < BITS:
        large = F.col("_size") > GROUP_ROWS
        if open_.where(large).isEmpty():
            break
        ready.append((open_.where(~large), bits))
        big, step = open_.where(large), F.shiftright(F.col("_entry")["_place"], BITS - bits - RADIX).bitwiseAND(F.lit((1 << RADIX) - 1))
        counted = _inside(rows, big, bits).groupBy("_g", "_prefix", step.alias("_next")).agg(F.count("*").alias("_n"))
        found = _at_rank(big, counted, "_next")
        open_ = durable(
            found.select(
                "_g", (F.col("_rank") - F.col("_before")).alias("_rank"),
                F.shiftleft("_prefix", RADIX).bitwiseOR(F.col("_next")).alias("_prefix"), F.col("_n").alias("_size"),
            )
        )
        bits += RADIX
    ready.append((open_, bits))
    cuts = []
    for part, at in ready:
        # without any large group all rows are looked at
        inside = rows.withColumn("_prefix", F.lit(0).cast("bigint")) if bits == 0 else _inside(rows, part, at)
        counted = inside.groupBy("_g", "_prefix", "_entry").agg(F.count("*").alias("_n"))
        cuts.append(_at_rank(part, counted, "_entry").select("_g", "_entry"))
    listed = reduce(DataFrame.unionByName, cuts).groupBy("_g").agg(F.sort_array(F.collect_list("_entry")).alias("_cuts"))
    return durable(listed.join(wanted, "_g"))


def with_cuts(df: DataFrame, group: str, cuts: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns made from ``_cuts``, the cuts of the row's group (null without a group); hot groups are safe."""
    joined = join_back(df.withColumn("_g", known(df, group)), cuts, ["_g"], "_size", how="left")
    return joined.select(*[quoted(c) for c in df.columns], *[c.alias(n) for n, c in columns.items()])
