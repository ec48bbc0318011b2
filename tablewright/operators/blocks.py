"""All-to-all distance work in bounded blocks.

Rows are dealt into blocks of limited size, blocks meet in pairs inside one task, and a task gives back only
sums or the nearest few, never the pairs.  Numpy does the arithmetic of one block pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.plans.durable import durable

BLOCK_ROWS = 4000
MAX_PIVOTS = 2048


#: Entries of a distance matrix held at once.
ENTRIES = 4_000_000
#: Squares below this share of the squared lengths lose digits to cancellation and are taken from the differences instead.
CANCELLED = 1e-2
#: Entries of a product searched at once, and columns of it whose least entry is looked at first.
TILE = 4_000_000
GROUP = 32
#: Points of this width and more are proposed in single precision.
SINGLE_WIDTH = 16


def _gaps(a: np.ndarray, b: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Squared distances of the row pairs (i, k), from their differences."""
    out = np.empty(len(i))
    step = max(1, ENTRIES // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        gap = a[i[at : at + step]] - b[k[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", gap, gap)
    return out


def _centred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both matrices moved to the middle of the second, which shortens their rows, and the squared lengths of the rows."""
    whole = b[np.isfinite(b).all(axis=1)]
    middle = whole.mean(axis=0) if len(whole) else 0.0
    a, b = a - middle, b - middle
    return a, b, np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices, from a matrix product: fast, and good to about 13 digits.

    Where the product cancels, and among entries that are not finite, the differences are squared instead.
    """
    a, b = np.ascontiguousarray(a, dtype="float64"), np.ascontiguousarray(b, dtype="float64")
    with np.errstate(all="ignore"):
        x, y, xx, yy = _centred(a, b)
        out = x @ y.T
        out *= -2
        out += xx[:, None]
        out += yy[None, :]
        lengths = xx[:, None] + yy[None, :]
        lengths *= CANCELLED
        i, k = np.nonzero(~(out > lengths))
        out[i, k] = _gaps(a, b, i, k)
    return out


def distances(a: np.ndarray, b: np.ndarray, edges: Sequence[float] = ()) -> np.ndarray:
    """Euclidean distances between the rows of two matrices, good to about 13 digits.

    Those next to one of ``edges`` are taken from the differences, so that a comparison with it tells what the plain formula tells.
    """
    out = np.empty((len(a), len(b)))
    step = max(1, ENTRIES // max(1, len(b)))
    for at in range(0, len(a), step):
        part = squares(a[at : at + step], b)
        np.sqrt(part, out=part)
        if len(edges):
            close = np.zeros(part.shape, dtype=bool)
            for e in edges:
                close |= np.abs(part - e) <= 1e-9 * max(1.0, abs(e))
            i, k = np.nonzero(close)
            part[i, k] = np.sqrt(_gaps(a[at : at + step], b, i, k))
        out[at : at + step] = part
    return out


def within(a: np.ndarray, b: np.ndarray, radii: Sequence[float], entries: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, row of a, row of b, level) for slice after slice of a: the pairs at most the largest of the ascending radii apart.

    ``level`` counts the radii that a pair exceeds. A product tells it, in single precision for wide points; pairs too near to a radius
    for that are decided by the plain formula. No more than ``entries`` pairs are looked at at once.
    """
    a, b = np.ascontiguousarray(a, dtype="float64"), np.ascontiguousarray(b, dtype="float64")
    with np.errstate(all="ignore"):
        x, y, xx, yy = _centred(a, b)
    # rows whose square has no number are left to the plain formula
    wild_a, wild_b = ~np.isfinite(xx), ~np.isfinite(yy)
    tame = ~wild_b
    x[wild_a], xx[wild_a] = 0.0, 0.0
    there, others = np.flatnonzero(tame), np.flatnonzero(wild_b)
    lengths = xx + (yy[tame].max() if len(there) else 0.0)
    width, edges = a.shape[1], [float(e) for e in radii]
    left = np.concatenate([-2 * x, np.ones((len(x), 1)), xx[:, None]], axis=1)
    right = np.concatenate([y[tame], yy[tame, None], np.ones((len(there), 1))], axis=1).T
    # far above what the product can be off; single precision needs room for the squares
    kinds = {"float64": max(1e-12, 4e-16 * (width + 10)) * lengths}
    if width >= SINGLE_WIDTH and len(lengths) and 1e-20 < lengths.max() < 1e30 and edges[-1] < 1e15:
        kinds = {"float32": 2.0 * np.finfo("float32").eps * (width + 10) * lengths, **kinds}
    cast = {kind: (left.astype(kind), np.ascontiguousarray(right, dtype=kind)) for kind in kinds}
    step = max(1, (entries or ENTRIES) // max(1, len(b)))
    for at in range(0, len(a), step):
        low, high = at, min(at + step, len(a))
        for kind in list(kinds):
            l, r = cast[kind]
            error = kinds[kind][low:high]
            near = l[low:high] @ r
            found = np.flatnonzero(near <= (edges[-1] ** 2 + error)[:, None].astype(kind) * (1 + 4 * np.finfo(kind).eps))
            i, k = np.divmod(found, max(1, len(there)))
            square, error = near.ravel()[found].astype("float64"), error[i]
            level, unsure = np.zeros(len(found), dtype="int64"), np.zeros(len(found), dtype=bool)
            for e in edges:
                level += square > e * e
                unsure |= np.abs(square - e * e) <= error + 1e-9 * e * e
            if kind == "float64" or unsure.sum() <= max(1000, len(found) // 8):
                break
            del kinds[kind]  # too many rows next to a radius for single precision
        i, k = i + low, there[k]
        own = np.flatnonzero(wild_a[low:high]) + low
        if len(own) or len(others):
            sure = ~wild_a[i]
            whole = np.arange(low, high)
            more = [(np.repeat(own, len(b)), np.tile(np.arange(len(b)), len(own)))]
            more.append((np.repeat(whole[~wild_a[low:high]], len(others)), np.tile(others, int((~wild_a[low:high]).sum()))))
            i, k = np.concatenate([i[sure], *[m[0] for m in more]]), np.concatenate([k[sure], *[m[1] for m in more]])
            fresh = len(i) - int(sure.sum())
            level, unsure = np.concatenate([level[sure], np.zeros(fresh, dtype="int64")]), np.concatenate([unsure[sure], np.ones(fresh, dtype=bool)])
        if unsure.any():
            with np.errstate(all="ignore"):
                gap = np.sqrt(_gaps(a, b, i[unsure], k[unsure]))
            level[unsure] = sum((~(gap <= e)).astype("int64") for e in edges)
        keep = level < len(edges)
        yield low, high, i[keep], k[keep], level[keep]


def _proposed(left: np.ndarray, right: np.ndarray, group: int, k: int, error: np.ndarray, own: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of a product that can be among the ``k`` least of their row, when entries are off by ``error`` at most.

    The least entries of groups of columns come first: the k-th of them bounds the k-th entry, and only groups below it are looked at.
    """
    near = left @ right
    if own is not None:
        near[own] = np.inf
    parted = near.reshape(len(near), group, -1)
    least = parted.min(axis=1) if group > 1 else near
    bound = np.partition(least, k - 1, axis=1)[:, k - 1] if k < least.shape[1] else np.full(len(near), np.inf)
    bound = bound + 2 * error
    i, c = np.nonzero((least <= bound[:, None]) & (least < np.inf))
    if group == 1:
        return i, c
    entries = parted[i, :, c]
    at, member = np.nonzero((entries <= bound[i][:, None]) & (entries < np.inf))
    return i[at], member * parted.shape[2] + c[at]


def nearest_few(a: np.ndarray, b: np.ndarray, k: int, barred: Callable[[int, int], tuple] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the ``k`` nearest rows of b for every row of a; ties go to the earlier row of b.

    The product proposes, the plain formula decides. Wide points are proposed in single precision, unless that leaves too many.
    ``barred(from, to)`` gives the pairs (row from ``from`` on, row of b) that do not count; rows that are not finite have no neighbours.
    """
    a, b = np.ascontiguousarray(a, dtype="float64"), np.ascontiguousarray(b, dtype="float64")
    with np.errstate(all="ignore"):
        x, y, xx, yy = _centred(a, b)
    lost, usable = ~np.isfinite(xx), np.isfinite(yy)
    x[lost], y[~usable], yy[~usable] = 0.0, 0.0, np.inf
    longest = yy[usable].max() if usable.any() else 0.0
    lengths = np.where(lost, 0.0, xx) + longest
    width, group = a.shape[1], max(1, min(GROUP, len(b) // (8 * k)))
    spare = -len(b) % group  # columns that fill up the last group
    left = np.concatenate([-2 * x, np.ones((len(x), 1))], axis=1)
    right = np.concatenate([np.concatenate([y, yy[:, None]], axis=1), np.tile([0.0] * width + [np.inf], (spare, 1))]).T
    # far above what the product can be off; single precision needs room for the squares
    kinds = {"float64": max(1e-12, 4e-16 * (width + 8)) * lengths}
    if width >= SINGLE_WIDTH and len(lengths) and lengths.max() < 1e30:
        kinds = {"float32": (2.0 * np.finfo("float32").eps * (width + 8)) * lengths, **kinds}
    cast = {kind: (left.astype(kind), np.ascontiguousarray(right, dtype=kind)) for kind in kinds}
    found = []
    step = max(1, TILE // max(1, right.shape[1]))
    for at in range(0, len(a), step):
        own = None if barred is None else barred(at, min(at + step, len(a)))
        for kind in list(kinds):
            l, r = cast[kind]
            with np.errstate(all="ignore"):
                i, j = _proposed(l[at : at + step], r, group, k, kinds[kind][at : at + step], own)
            if kind == "float64" or len(i) <= 8 * k * step:
                break
            del kinds[kind]  # rows too close together for single precision
        d = np.sqrt(_gaps(a[at : at + step], b, i, j))
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (place < k) & np.isfinite(d) & ~lost[i + at]
        found.append((i[keep] + at, j[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _own_pairs(here: np.ndarray, there: np.ndarray) -> Callable[[int, int], tuple]:
    """Pairs of equal ids among a slice of ``here`` and all of ``there``, which is sorted."""

    def numbers(low: int, high: int) -> tuple:
        mine = here[low:high]
        first, last = (np.searchsorted(known, mine, side) for side in ("left", "right"))
        count = last - first
        i = np.repeat(np.arange(len(mine)), count)
        return i, np.arange(len(i)) - np.repeat(count.cumsum() - count, count) + np.repeat(first, count)

    if here.dtype.kind == there.dtype.kind and here.dtype.kind in "iuf":
        known = there if there.dtype.kind != "f" else there[~np.isnan(there)]  # null equals nothing here; it is sorted last
        return numbers
    return lambda low, high: np.nonzero(here[low:high, None] == there[None, :])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def block_rows(n: int, width: int, least: int | None = None) -> int:
    """Rows of a block: of wide points, whose cells rule out little, up to eight times as many as ``least``, so that fewer copies meet."""
    least = least or BLOCK_ROWS
    return min(least * max(1, min(8, width // 8)), max(least, n // 16))


def random_pivots(df: DataFrame, point: str, n: int, least: int | None = None) -> np.ndarray:
    """Random rows as cell centres; at most ``MAX_PIVOTS`` of them reach the driver."""
    wanted = min(MAX_PIVOTS, max(1, math.ceil(n / (least or BLOCK_ROWS))))
    points = df.select(point)
    rows = points.sample(min(1.0, wanted / max(n, 1)), 11).collect() or points.limit(1).collect()
    found = np.array([r[0] for r in rows], dtype="float64")
    few = math.ceil(n / block_rows(n, found.shape[1], least)) if found.ndim == 2 else len(found)
    return found if few >= len(found) else found[np.arange(few) * len(found) // few]


def _with_cell(df: DataFrame, point: str, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(_matrix(batch[point]), pivots)
                yield batch.assign(_cell=d.argmin(axis=1).astype("int32"), _gap=d.min(axis=1))

    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())])
    return df.mapInPandas(assign, schema)


def _homes(k: int, pivots: np.ndarray, radius: np.ndarray, size: np.ndarray, extra: int):
    """The nearest cell with rows of every point, and a distance that its k-th nearest row does not exceed.

    It is at most the least far end (distance to the pivot plus radius) of a cell with k rows. Where no cell has so many, it is at
    most the far end of the cell at which the far ends, taken in order, have gathered k rows.
    """
    need = k + extra
    whole = size >= need

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = distances(_matrix(batch["point"]), pivots)
            far = d + radius
            if whole.any():
                bound = far[:, whole].min(axis=1)
            else:
                order = far.argsort(axis=1)
                gathered = size[order].cumsum(axis=1) >= need
                bound = np.take_along_axis(far, np.take_along_axis(order, gathered.argmax(axis=1)[:, None], 1), 1)[:, 0]
                bound = np.where(gathered[:, -1], bound, np.inf)
            home = np.where(size > 0, d, np.inf).argmin(axis=1)
            yield batch.assign(_cell=home.astype("int32"), _bound=bound)

    return run


def _reachable(pivots: np.ndarray, radius: np.ndarray, size: np.ndarray):
    """Cells besides the own one that can hold a row within ``_bound`` of a point.

    Left out are cells whose near end lies beyond it, and those whose pivot is farther than the own one by more than twice
    the bound: every row of a cell is nearer to its pivot than to the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = distances(_matrix(batch["point"]), pivots)
            own, bound = batch["_cell"].to_numpy(), batch["_bound"].to_numpy()[:, None]
            slack = 1e-9 * (d + radius)
            at_home = np.take_along_axis(d, own[:, None].astype("int64"), 1)
            near = (d - radius <= bound + slack) & (d - at_home <= 2 * bound + slack) & (size > 0)
            near[np.arange(len(batch)), own] = False
            cells = [np.flatnonzero(row).astype("int32").tolist() for row in near]
            yield batch.drop(columns=["_cell", "_bound"]).assign(_cells=cells)

    return run


@dataclass
class Index:
    """Rows (id, point, label) grouped around pivots: the fitted state of every search for neighbours.

    ``rows`` has the cell of each row; radius and size are known per cell.
    """

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @staticmethod
    def build(train: DataFrame, keep: bool = False) -> Index:
        """Group the rows of ``train``; with ``keep`` the grouped rows are written, for many searches."""
        pivots = random_pivots(train, "point", train.count())
        placed = _with_cell(train.select("id", "point", "label"), "point", pivots)
        placed = durable(placed) if keep else placed
        size, radius = np.zeros(len(pivots), dtype="int64"), np.zeros(len(pivots))
        for c in placed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_gap").alias("r")).collect():
            size[c["_cell"]], radius[c["_cell"]] = c["n"], c["r"]
        return Index(placed, pivots, radius, size)

    def save(self, path: str) -> None:
        """The rows, cell by cell, and what is known of the cells."""
        self.rows.repartition("_cell").sortWithinPartitions("_cell").write.parquet(f"{path}/rows")
        cells = [(i, [float(v) for v in p], float(r), int(n)) for i, (p, r, n) in enumerate(zip(self.pivots, self.radius, self.size))]
        self.rows.sparkSession.createDataFrame(cells, "cell int, pivot array<double>, radius double, size bigint").coalesce(1).write.parquet(f"{path}/cells")

    @staticmethod
    def load(spark, path: str) -> Index:
        cells = sorted(spark.read.parquet(f"{path}/cells").collect())
        return Index(
            spark.read.parquet(f"{path}/rows"), np.array([c["pivot"] for c in cells]),
            np.array([c["radius"] for c in cells]), np.array([c["size"] for c in cells], dtype="int64"),
        )

    def nearest(self, test: DataFrame, k: int, same: bool = False) -> DataFrame:
        """The exact ``k`` nearest rows of every row (id, point) of ``test``, as :func:`nearest` gives them.

        Every row searches its own cell first; what it finds there bounds the cells that it has to visit.
        """
        pivots, size, radius = self.pivots, self.size, self.radius
        kind = test.schema["id"].dataType
        plain = [T.StructField("id", kind), test.schema["point"]]
        homes = T.StructType([*plain, T.StructField("_cell", T.IntegerType()), T.StructField("_bound", T.DoubleType())])
        probes = durable(test.select("id", "point").mapInPandas(_homes(k, pivots, radius, size, 1 if same else 0), homes))
        order = Window.partitionBy("test_id").orderBy("distance", "train_id")
        few = lambda found: found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        first = durable(few(self._meet(probes.drop("_bound"), k, same, kind)))
        reached = first.where(F.col("place") == k).select(F.col("test_id").alias("id"), F.col("distance").alias("_found"))
        bounded = probes.join(reached, "id", "left").withColumn("_bound", F.least("_bound", "_found")).select(*homes.fieldNames())
        visits = T.StructType([*plain, T.StructField("_cells", T.ArrayType(T.IntegerType()))])
        visiting = durable(bounded.mapInPandas(_reachable(pivots, radius, size), visits))  # placed once
        more = self._meet(visiting.withColumn("_cell", F.explode("_cells")).drop("_cells"), k, same, kind)
        # a test row has at most k candidates per block it met
        return few(first.drop("place").unionByName(more))

    def _meet(self, probes: DataFrame, k: int, same: bool, kind: T.DataType) -> DataFrame:
        """Candidates (test_id, train_id, distance, label): the nearest rows in each block of the cells (_cell) of the probes."""
        limit = block_rows(int(self.size.sum()), self.pivots.shape[1])
        blocks = [max(1, math.ceil(n / limit)) for n in self.size.tolist()]
        slices = [0] * len(self.pivots)
        for c in probes.groupBy("_cell").agg(F.count("*").alias("n")).collect():
            slices[c["_cell"]] = max(1, math.ceil(c["n"] / limit))
        of = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("_cell") + 1)
        every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
        dealt = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
        right = self.rows.where(of(slices) > 0).select("_cell", dealt(of(blocks)).alias("_block"), "id", "point", "label")
        right = right.withColumn("_slice", every(of(slices)))
        left = probes.withColumn("_slice", dealt(of(slices))).withColumn("_block", every(of(blocks)))
        schema = T.StructType(
            [
                T.StructField("test_id", kind),
                T.StructField("train_id", self.rows.schema["id"].dataType),
                T.StructField("distance", T.DoubleType()),
                T.StructField("label", self.rows.schema["label"].dataType),
            ]
        )

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame(columns=["test_id", "train_id", "distance", "label"])
            b = b.sort_values("id", kind="stable")
            here, there = a["id"].to_numpy(), b["id"].to_numpy()
            i, j, d = nearest_few(_matrix(a["point"]), _matrix(b["point"]), k, _own_pairs(here, there) if same else None)
            return pd.DataFrame({"test_id": here[i], "train_id": there[j], "distance": d, "label": b["label"].to_numpy()[j]})

        keys = ["_cell", "_block", "_slice"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def nearest(train: DataFrame, test: DataFrame, k: int, same: bool = False) -> DataFrame:
    """The exact ``k`` nearest train rows of every test row: (test_id, train_id, distance, label, place).

    ``train`` has (id, point, label), ``test`` has (id, point); ids are unique, ties go to the smaller id.
    ``same`` leaves a row out of its own neighbours (train and test share ids).  Train rows are grouped around
    pivots; a test row meets only the cells that the triangle inequality cannot rule out.  Large cells are cut
    into blocks by a hash of the id and the test rows that meet a block are cut likewise, so that no task holds
    more than a block of either side.
    """
    return Index.build(train, keep=True).nearest(test, k, same)


def block_sums(df: DataFrame, groups: Sequence, schema: str) -> DataFrame:
    """Sums of the distances of every row (id, point, group) to the rows of each group: (id, sums in the order of ``groups``), in parts to be added.

    The work is quadratic by nature; every two blocks meet once, for both of them. Memory and output stay bounded by the block size.
    """
    n = df.count()
    first = df.select(F.size("point").alias("d")).first()
    blocks = max(1, math.ceil(n / block_rows(n, first["d"] if first else 1)))
    dealt = df.withColumn("_i", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = dealt.withColumnRenamed("_i", "_a").withColumn("_b", F.explode(F.filter(others, lambda o: o >= F.col("_a"))))
    right = dealt.withColumnRenamed("_i", "_b").withColumn("_a", F.explode(F.filter(others, lambda o: o <= F.col("_b"))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides come from one table
    codes = {g: i for i, g in enumerate(groups)}

    def members(side: pd.DataFrame) -> np.ndarray:
        code = side["group"].map(codes).to_numpy(dtype="float64")
        return (code[:, None] == np.arange(len(codes))[None, :]).astype("float64")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
        x, y, of_a, of_b = _matrix(a["point"]), _matrix(b["point"]), members(a), members(b)
        to_b, to_a = np.empty((len(a), len(codes))), np.zeros((len(b), len(codes)))
        step = max(1, ENTRIES // len(b))
        for at in range(0, len(a), step):
            d = distances(x[at : at + step], y)
            to_b[at : at + step] = d @ of_b
            to_a += d.T @ of_a[at : at + step]
        out = pd.DataFrame({"id": a["id"].to_numpy(), "sums": list(to_b)})
        if key[0] == key[1]:
            return out
        return pd.concat([out, pd.DataFrame({"id": b["id"].to_numpy(), "sums": list(to_a)})])

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(meet, schema)
