"""Ordered computations without a one-task window.

A window without ``partitionBy`` sends the whole table to one task, and a window over a key sends each hot
key to one task.  Here the rows are first cut into chunks of consecutive rows: boundaries are drawn from a
small random sample of the order keys, turned into literals and looked up per row, so a chunk is an ordinary
column that any later stage or retry computes alike.  Windows then run per (partition, chunk), and what has
to cross a border (running totals, last known values, neighbouring rows) travels in tables whose size is
bounded by the number of chunks.

``order_by`` must name columns that order the rows of a partition totally.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.plans.durable import durable
from tablewright.plans.types import epoch_micros, is_date, quoted

CHUNK_ROWS = 2_000_000
MAX_CHUNKS = 4096  # beyond it chunks grow instead: every border is a literal in the plan
_SAMPLE_PER_CHUNK = 20
_FLAT_LOOKUP = 64
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
_FEW_ROWS = 64
HOT_ROWS = 1_000_000
SPAN_SAMPLE = 20_000


@dataclass
class Chunks:
    data: DataFrame  # input plus the key columns and ``_chunk``
    partition: list[str]  # names of the partition key columns
    order: list[str]  # names of the order key columns
    count: int
    borders: DataFrame | None  # partition keys that may reach over a border, at most one per border

    def window(self, descending: bool = False):
        order = [F.col(o).desc() if descending else F.col(o).asc() for o in self.order]
        return Window.partitionBy(*self.partition, "_chunk").orderBy(*order)

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.partition, *self.order, "_chunk")


def _key(df: DataFrame, name: str) -> Column:
    return epoch_micros(quoted(name)) if is_date(df.schema[name].dataType) else quoted(name)


def _lookup(key: Column, bounds: list[Column]) -> Column:
    """How many of the ascending bounds are at or below the key (two levels, so about 2 * sqrt(n) comparisons)."""

    def at_or_below(candidates: Column) -> Column:
        return F.size(F.filter(candidates, lambda b: b <= key))

    if len(bounds) <= _FLAT_LOOKUP:
        return at_or_below(F.array(*bounds))
    step = math.isqrt(len(bounds))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    group = at_or_below(F.array(*[g[0] for g in groups])) - 1
    inner = F.element_at(F.array(*[F.array(*g) for g in groups]), F.greatest(group, F.lit(0)) + 1)
    return F.when(group < 0, 0).otherwise(group * step + at_or_below(inner))


def chunked(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), rows: int | None = None, chunk_rows: int | None = None
) -> Chunks:
    """Cut ``df`` into chunks of about ``chunk_rows`` (``CHUNK_ROWS``) consecutive rows, at most ``MAX_CHUNKS``, in (partition, order) order."""
    partition = [f"_p{i}" for i in range(len(partition_by))]
    order = [f"_o{i}" for i in range(len(order_by))]
    names = [*partition, *order]
    data = df.withColumns({n: _key(df, c) for n, c in zip(names, [*partition_by, *order_by])})
    total = df.count() if rows is None else rows
    wanted = min(MAX_CHUNKS, math.ceil(total / (chunk_rows or CHUNK_ROWS)))
    if wanted <= 1:
        return Chunks(data.withColumn("_chunk", F.lit(0)), partition, order, 1, None)
    # about wanted * _SAMPLE_PER_CHUNK rows whatever the size of the table, so the driver gets a bounded sample
    share = min(1.0, wanted * _SAMPLE_PER_CHUNK / total)
    sample = data.select(*names).sample(share, 7).orderBy(*names).collect()
    spots = [i * len(sample) // wanted for i in range(1, wanted)]
    picked = list(dict.fromkeys(tuple(sample[i]) for i in spots)) if sample else []
    if not picked:
        return Chunks(data.withColumn("_chunk", F.lit(0)), partition, order, 1, None)
    fields = [data.schema[n] for n in names]
    bounds = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields)]) for values in picked
    ]
    data = data.withColumn("_chunk", _lookup(F.struct(*names), bounds).cast("int"))
    borders = None
    if partition:
        keys = list(dict.fromkeys(v[: len(partition)] for v in picked))
        schema = data.select(*partition).schema
        borders = df.sparkSession.createDataFrame(keys, schema)
    return Chunks(data, partition, order, len(picked) + 1, borders)


def _over_borders(chunks: Chunks) -> DataFrame:
    """Rows of the partitions that may lie in more than one chunk."""
    if chunks.borders is None:
        return chunks.data
    match = F.lit(True)
    for p in chunks.partition:
        match = match & F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}"))
    return chunks.data.alias("l").join(F.broadcast(chunks.borders).alias("r"), match, "left_semi")


def _add_carry(out: DataFrame, ends: DataFrame, chunks: Chunks, carried: Mapping[str, Column], descending: bool) -> DataFrame:
    """Join to every row what the earlier chunks of its partition hand over.

    ``ends`` has one row per partition and chunk near a border, so it is bounded by the number of chunks.
    """
    across = Window.partitionBy(*chunks.partition).orderBy(F.col("_chunk").desc() if descending else F.col("_chunk"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*chunks.partition, "_chunk", *[c.over(earlier).alias(n) for n, c in carried.items()])
    match = F.col("l._chunk") == F.col("r._chunk")
    for p in chunks.partition:
        match = match & F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}"))
    joined = out.alias("l").join(F.broadcast(carry).alias("r"), match, "left")
    return joined.select("l.*", *[F.col(f"r.{n}").alias(n) for n in carried])


def running_sums(
    df: DataFrame,
    order_by: Sequence[str],
    sums: Mapping[str, Column],
    descending: bool = False,
    partition_by: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Running totals in the given order, over the whole table or per partition, the current row included."""
    chunks = chunked(df, order_by, partition_by, rows)
    parts = {f"_s{i}": c for i, c in enumerate(sums.values())}
    data = chunks.data.withColumns(parts)
    window = chunks.window(descending).rowsBetween(Window.unboundedPreceding, 0)
    out = data.withColumns({name: F.sum(s).over(window) for name, s in zip(sums, parts)})
    if chunks.count > 1:
        near = _over_borders(Chunks(data, chunks.partition, chunks.order, chunks.count, chunks.borders))
        ends = near.groupBy(*chunks.partition, "_chunk").agg(*[F.sum(s).alias(s) for s in parts])
        out = _add_carry(out, ends, chunks, {f"{s}_before": F.sum(s) for s in parts}, descending)
        zero = F.lit(0)
        out = out.withColumns(
            {n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"{s}_before"), zero) for n, s in zip(sums, parts)}
        ).drop(*[f"{s}_before" for s in parts])
    return chunks.clean(out).drop(*parts)


def row_numbers(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "row_number",
    descending: bool = False,
    partition_by: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Position of every row in the order of the table or of its partition, from 1."""
    return running_sums(df, order_by, {name: F.lit(1).cast("bigint")}, descending, partition_by, rows)


def rows_between(df: DataFrame, order_by: Sequence[str], low: int, high: int, rows: int) -> DataFrame:
    """The rows at positions ``low`` + 1 to ``high`` of a table of ``rows`` rows in the given total order, without sorting the table.

    A sample proposes a span of keys around the positions, a scan counts the rows before and inside it, and only those inside are numbered.
    """
    order = [f"_o{i}" for i in range(len(order_by))]
    data = df.withColumns({o: _key(df, c) for o, c in zip(order, order_by)})
    sample = data.select(*order).sample(min(1.0, SPAN_SAMPLE / max(rows, 1)), 7).orderBy(*order).collect()
    fields = [data.schema[o] for o in order]

    def spot(position: int, side: int) -> int:
        share = min(1.0, position / max(rows, 1))
        return math.floor(share * len(sample) + side * (10 + 5 * math.sqrt(len(sample) * share * (1 - share))))

    def bound(at: int) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(sample[at], fields)])

    key, first, last = F.struct(*order), spot(low, -1), spot(high, 1)
    above = key >= bound(first) if first >= 0 and sample else F.lit(True)
    below = key < bound(last) if last < len(sample) else F.lit(True)
    before, inside = data.agg(F.count_if(~above), F.count_if(above & below)).first()
    if before > low or before + inside < min(high, rows):  # the sample was far off
        above, below, before, inside = F.lit(True), F.lit(True), 0, rows
    numbered = row_numbers(data.where(above & below).drop(*order), order_by, "_row", rows=inside)
    return numbered.where((F.col("_row") > low - before) & (F.col("_row") <= high - before)).drop("_row")


def _neighbours(chunks: Chunks, reach: int, forward: bool) -> DataFrame:
    """Copies of the rows within ``reach`` of a chunk border, re-labelled with the chunk that needs them."""
    rank = F.row_number().over(chunks.window(descending=forward))
    edge = _over_borders(chunks).withColumn("_rank", rank).where(F.col("_rank") <= reach)
    # every chunk inside a partition holds at least its own lower bound, so `reach` chunks hold `reach` rows
    step = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    moved = edge.withColumn("_step", step).withColumn(
        "_chunk", F.col("_chunk") + F.col("_step") * (1 if forward else -1)
    )
    moved = moved.withColumn("_rank", F.row_number().over(chunks.window(descending=forward)))
    return moved.where(F.col("_rank") <= reach).drop("_rank", "_step")


def windowed(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    columns: Callable[[object], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
    rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns(window)`` returns the columns by name; partitions of any size are spread over chunks.
    """
    chunks = chunked(df, order_by, partition_by, rows, chunk_rows)
    data = chunks.data.withColumn("_copy", F.lit(False))
    if chunks.count > 1:
        for reach, forward in ((before, True), (after, False)):
            if reach:
                data = data.unionByName(_neighbours(chunks, reach, forward).withColumn("_copy", F.lit(True)))
    out = data.withColumns(dict(columns(chunks.window()))).where(~F.col("_copy")).drop("_copy")
    return chunks.clean(out)


def fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    forward: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Replace nulls by the last known value before them (or the next one after them)."""
    chunks = chunked(df, order_by, partition_by, rows)
    window = chunks.window(descending=not forward).rowsBetween(Window.unboundedPreceding, 0)
    out = chunks.data.withColumns({c: F.last(quoted(c), ignorenulls=True).over(window) for c in columns})
    if chunks.count == 1:
        return chunks.clean(out)
    key = F.struct(*chunks.order)
    pick = F.max_by if forward else F.min_by
    held = {f"_f{i}": c for i, c in enumerate(columns)}
    ends = (
        _over_borders(chunks)
        .groupBy(*chunks.partition, "_chunk")
        .agg(*[pick(quoted(c), F.when(quoted(c).isNotNull(), key)).alias(f) for f, c in held.items()])
    )
    out = _add_carry(out, ends, chunks, {f"{f}_before": F.last(f, ignorenulls=True) for f in held}, not forward)
    before = {c: F.col(f"{f}_before") for f, c in held.items()}
    return out.select(*[F.coalesce(quoted(c), before[c]).alias(c) if c in before else quoted(c) for c in df.columns])


def _width(lookup: DataFrame) -> Column | None:
    """Bytes of a row of text and lists, as far as they vary; None where all columns are plain."""
    parts = []
    for f in lookup.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(quoted(f.name)))
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
            parts.append(F.size(quoted(f.name)) * 8 * len(getattr(f.dataType.elementType, "fields", [0])))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.octet_length(F.to_json(F.struct(quoted(f.name)))))
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)).cast("bigint") if parts else None


def _broadcastable(lookup: DataFrame, size: int | None) -> bool:
    """Whether rows and bytes of the lookup are within the limits of a broadcast."""
    width, plain = _width(lookup), 16 * len(lookup.columns)
    if size is None or (width is not None and _FEW_ROWS < size <= BROADCAST_ROWS):
        size, bytes_ = lookup.agg(F.count("*"), F.sum(F.lit(0) if width is None else width)).first()
    else:
        bytes_ = 0
    return size <= BROADCAST_ROWS and size * plain + (bytes_ or 0) <= BROADCAST_BYTES


def join_back(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", size: int | None = None
) -> DataFrame:
    """Join ``df`` (inner or left) with one row per key, safe against hot keys.

    ``weight`` is the number of rows of ``df`` behind each key, ``size`` the rows of the lookup if known.  A small lookup is broadcast after its rows
    and bytes are checked.  Otherwise the few keys heavier than ``HOT_ROWS`` are broadcast and the rest is shuffled.
    """
    small = _broadcastable(lookup, size)
    match = {k: f"_k{i}" for i, k in enumerate(keys)}
    lookup = lookup.withColumnsRenamed(match)
    same = F.lit(True)
    for key, other in match.items():
        same = same & quoted(key).eqNullSafe(F.col(other))  # null is a key like any other

    def joined(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
        return left.join(right, same, kind).drop(*match.values())

    if small:
        return joined(df, F.broadcast(lookup.drop(weight)), how)
    hot = lookup.where(F.col(weight) > HOT_ROWS)
    cold = lookup.where(F.col(weight) <= HOT_ROWS)
    few = F.broadcast(hot.drop(weight))  # at most rows / HOT_ROWS keys can be this heavy
    rest = joined(df, few, "left_anti")
    return joined(df, few, "inner").unionByName(joined(rest, cold.drop(weight), how))


def ranks(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Add ``rank`` and ``dense_rank`` over the whole table, computed on the distinct values."""
    counted = df.groupBy(quoted(column).alias("_v")).agg(F.count("*").alias("_n"))
    size = counted.count()
    if size > BROADCAST_ROWS:
        counted = durable(counted)  # read several times below
    one = F.lit(1).cast("bigint")
    table = running_sums(counted, ["_v"], {"_upto": F.col("_n"), "dense_rank": one}, descending, rows=size)
    table = table.select(F.col("_v").alias(column), "_n", (F.col("_upto") - F.col("_n") + 1).alias("rank"), "dense_rank")
    return join_back(df, table, [column], "_n", size=size)
