"""Density clustering (DBSCAN), exact, without comparing all pairs; points of up to four dimensions use a grid.

Equal points are folded into one with a weight.  Space is cut into cells whose diagonal is ``eps``, so the
points of a cell are all neighbours: a cell that holds ``min_samples`` rows needs no comparison at all, however
many rows it has.  Only points of emptier cells count their neighbours; a cell has fewer than ``min_samples`` of
those, so the comparisons stay linear in the rows.  Two cells are linked when some pair of their core points
is within ``eps``; boxes around the points settle most cell pairs, the others are halved until they do.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.metric import dbscan_any
from tablewright.plans.durable import durable
from tablewright.plans.graph import components
from tablewright.plans.ordered import join_back, row_numbers

PAIRS_AT_ONCE = 2500
BLOCK_ROWS = 4000
MAX_DIMENSIONS = 4


def _squared(a: str, b: str, d: int) -> Column:
    return sum(((F.col(f"{a}{i}") - F.col(f"{b}{i}")) ** 2 for i in range(d)), F.lit(0.0))


def _box(d: int) -> list[Column]:
    return [f(f"x{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]


def _near(d: int) -> Column:
    """Squared distance of the closest points two boxes (l, r) could hold."""
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"l.lo{i}") - F.col(f"r.hi{i}"), F.col(f"r.lo{i}") - F.col(f"l.hi{i}")) for i in range(d)
    ]
    return sum((g * g for g in gaps), F.lit(0.0))


def _far(d: int) -> Column:
    """Squared distance of the farthest points two boxes (l, r) could hold."""
    gaps = [F.greatest(F.col(f"l.hi{i}") - F.col(f"r.lo{i}"), F.col(f"r.hi{i}") - F.col(f"l.lo{i}")) for i in range(d)]
    return sum((g * g for g in gaps), F.lit(0.0))


def _grid(names: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(n) / F.lit(side)) for n in names])


def _offsets(d: int, half: bool = False) -> list[tuple[int, ...]]:
    """Steps to the cells that can hold a point within ``eps``; with ``half`` one of each opposite pair."""
    reach = math.ceil(math.sqrt(d))
    out = []
    for step in product(range(-reach, reach + 1), repeat=d):
        if sum(max(0, abs(s) - 1) ** 2 for s in step) <= d and (not half or step > (0,) * d):
            out.append(step)
    return out


def _shifted(cell: str, steps: list[tuple[int, ...]]) -> Column:
    moves = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in step]) for step in steps])
    return F.explode(F.transform(moves, lambda m: F.zip_with(F.col(cell), m, lambda a, b: a + b)))


def _met(probes: DataFrame, targets: DataFrame, cells: DataFrame, eps: float, d: int) -> DataFrame:
    """Probe points (p0.., few per cell) with the target points (x0.., n) within ``eps`` in the cells around them.

    Targets of a full cell are spread over slices, and the few probes that look at it are copied to each.
    """
    slices = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    looks = probes.withColumn("cell", _shifted("home", _offsets(d))).join(cells.select("cell", slices.alias("slices")), "cell")
    looks = looks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    sliced = targets.withColumn("slice", F.pmod(F.xxhash64(*[f"x{i}" for i in range(d)]), slices).cast("int"))
    return looks.join(sliced.drop("n"), ["cell", "slice"]).where(_squared("p", "x", d) <= eps * eps)


def _edges(core: DataFrame, eps: float, side: float, d: int) -> DataFrame:
    """Pairs (a, b) of neighbouring cells that hold core points within ``eps`` of each other."""
    boxes = durable(core.groupBy("cell").agg(F.count("*").alias("n"), *_box(d)))
    left = boxes.withColumn("other", _shifted("cell", _offsets(d, half=True)))
    open_ = left.alias("l").join(boxes.alias("r"), F.col("l.other") == F.col("r.cell")).where(_near(d) <= eps * eps)
    open_ = open_.select(
        F.col("l.cell").alias("a"), F.col("r.cell").alias("b"), F.col("l.cell").alias("ka"), F.col("r.cell").alias("kb"),
        F.col("l.n").alias("na"), F.col("r.n").alias("nb"), (_far(d) <= eps * eps).alias("linked"),
    )
    open_ = durable(open_)
    found = open_.where("linked").select("a", "b")
    open_ = open_.where("NOT linked").drop("linked")
    level = 0
    names = [f"x{i}" for i in range(d)]
    while not open_.isEmpty():
        at = _grid(names, side / 2**level)
        pieces = core.select("cell", *names, at.alias("key"))
        few = F.col("na") * F.col("nb") <= PAIRS_AT_ONCE
        small = open_.where(few)
        la = pieces.select(F.col("cell").alias("a"), F.col("key").alias("ka"), *[F.col(n).alias(f"p{i}") for i, n in enumerate(names)])
        rb = pieces.select(F.col("cell").alias("b"), F.col("key").alias("kb"), *names)
        compared = small.join(la, ["a", "ka"]).join(rb, ["b", "kb"]).where(_squared("p", "x", d) <= eps * eps)
        found = durable(found.unionByName(compared.select("a", "b")).distinct())
        big = open_.where(~few).join(found, ["a", "b"], "left_anti")
        level += 1
        finer = core.select("cell", *names, at.alias("up"), _grid(names, side / 2**level).alias("key"))
        finer = finer.groupBy("cell", "up", "key").agg(F.count("*").alias("n"), *_box(d))
        l, r = finer.alias("l"), finer.alias("r")
        halves = (
            big.alias("u")
            .join(l, (F.col("u.a") == F.col("l.cell")) & (F.col("u.ka") == F.col("l.up")))
            .join(r, (F.col("u.b") == F.col("r.cell")) & (F.col("u.kb") == F.col("r.up")))
            .where(_near(d) <= eps * eps)
        )
        halves = halves.select(
            "u.a", "u.b", F.col("l.key").alias("ka"), F.col("r.key").alias("kb"), F.col("l.n").alias("na"), F.col("r.n").alias("nb"),
            (_far(d) <= eps * eps).alias("linked"),
        )
        halves = durable(halves)
        found = found.unionByName(halves.where("linked").select("a", "b")).distinct()
        open_ = halves.where("NOT linked").drop("linked").join(found, ["a", "b"], "left_anti")
        open_ = durable(open_)
    return found


def dbscan(df: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster) of (id, point): clusters from 0 by their smallest core id, noise -1.

    A border point between clusters joins the one with the smallest number.  Beyond ``MAX_DIMENSIONS`` points meet around
    pivots instead of in a grid.
    """
    first = df.where(F.col("point").isNotNull()).select(F.size("point").alias("d")).first()
    d = first["d"] if first else 0
    if not 0 < d <= MAX_DIMENSIONS:
        return dbscan_any(df, eps, min_samples)
    names = [f"x{i}" for i in range(d)]
    side = eps / math.sqrt(d) * (1 - 1e-9)
    rows = df.select("id", *[F.col("point")[i].cast("double").alias(n) for i, n in enumerate(names)])
    points = rows.groupBy(*names).agg(F.count("*").alias("weight"), F.min("id").alias("first_id"))
    points = durable(points.withColumn("cell", _grid(names, side)))
    cells = durable(points.groupBy("cell").agg(F.count("*").alias("n"), F.sum("weight").alias("w")))
    placed = join_back(points, cells.withColumn("size", F.col("n")), ["cell"], "size")
    full = placed.where(F.col("w") >= min_samples)
    sparse = placed.where(F.col("w") < min_samples)
    probes = sparse.select(F.col("cell").alias("home"), *[F.col(n).alias(f"p{i}") for i, n in enumerate(names)])
    at = [f"p{i}" for i in range(d)]
    near = _met(probes, placed, cells, eps, d).groupBy("home", *at).agg(F.sum("weight").alias("around"))
    found = near.where(F.col("around") >= min_samples).select(F.col("home").alias("cell"), *[F.col(p).alias(n) for p, n in zip(at, names)])
    kept = [*names, "cell", "first_id"]
    core = durable(full.select(*kept).unionByName(sparse.join(found, ["cell", *names], "left_semi").select(*kept)))
    if core.isEmpty():
        return df.select("id", F.lit(-1).alias("cluster"))
    linked = components(core.select(F.col("cell").alias("node")).distinct(), _edges(core, eps, side, d))
    sizes = core.groupBy("cell").agg(F.count("*").alias("n"), F.min("first_id").alias("first_id"))
    by_cell = sizes.join(linked.withColumnRenamed("node", "cell"), "cell")
    starts = by_cell.groupBy("root").agg(F.min("first_id").alias("first_id"), F.count("*").alias("cells"))
    numbers = row_numbers(starts, ["first_id"], "cluster").select("root", "cells", (F.col("cluster") - 1).cast("int").alias("cluster"))
    by_cell = durable(join_back(by_cell.select("cell", "root", "n"), numbers, ["root"], "cells").select("cell", "n", "cluster"))
    core = durable(join_back(core, by_cell.withColumn("size", F.col("n")), ["cell"], "size"))
    rest = sparse.join(core.select("cell", *names), ["cell", *names], "left_anti")
    border_probes = rest.select(F.col("cell").alias("home"), *[F.col(n).alias(f"p{i}") for i, n in enumerate(names)])
    border = _met(border_probes, core.select(*names, "cell", "n", "cluster"), by_cell, eps, d)
    border = border.groupBy(*at).agg(F.min("cluster").alias("cluster"))
    border = border.select(*[F.col(p).alias(n) for p, n in zip(at, names)], "cluster")
    marked = core.select(*names, "cluster").unionByName(border)
    marked = points.select(*names, "weight").join(marked, names, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return join_back(rows, durable(marked), names, "weight").select("id", "cluster")
