"""Density clustering (DBSCAN) of points of any width, exact, for many radii and minimum counts at once.

A range join in metric space: every point belongs to the cell of its nearest pivot and visits each cell that can hold a
point within the largest radius. By the triangle inequality such a cell's pivot is at most the cell's extent plus the radius
away, and at most twice the radius farther than the own pivot. Cells are cut into blocks, visitors into slices, and a task
compares one block with one slice.

Points visit their own block first, then a few more, then all others, and only as long as it can change something: a point
with enough neighbours within the smallest radius is core in every case, however many more it has; two core points of one
cluster need not meet again, so in the end only points outside the largest cluster of a case visit the blocks that are left;
and only points that are not core in some case look for a cluster to border on. Where points are dense the work is linear in
them; thin tables have all their pairs compared.

A task never returns pairs. It counts neighbours within every radius; it returns the edges that connect the clusters known
so far; and it returns the smallest cluster that a border point touches. Equal points are folded into one with a weight first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.operators.blocks import ENTRIES, block_rows, distances, random_pivots, within
from tablewright.plans import wide
from tablewright.plans.durable import durable
from tablewright.plans.graph import components
from tablewright.plans.ordered import join_back, row_numbers

BLOCK_ROWS = 1000
#: Blocks that a point visits before clusters are known across blocks; up to so many more than these it visits all at once.
FIRST_BLOCKS, FEW_MORE = 4, 2
_FAR = np.iinfo(np.int32).max


def _point() -> Column:
    """The point as doubles, without negative zeros: equal points have to be equal keys."""
    return F.transform("point", lambda c: c.cast("double") + F.lit(0.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.to_numpy()).reshape(len(column), -1)


def _at_home(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the cell of the nearest pivot and the distance to it."""

    def assign(batches):
        for batch in batches:
            if len(batch):
                d = distances(_matrix(batch["point"]), pivots)
                yield batch.assign(cell=d.argmin(axis=1).astype("int32"), gap=d.min(axis=1))

    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    return points.mapInPandas(assign, schema)


def _visiting(placed: DataFrame, pivots: np.ndarray, extent: np.ndarray, size: np.ndarray, radius: float, limit: int) -> DataFrame:
    """Replace cell and gap by ``home``, the own block, and ``visits``, the blocks of all cells that can hold a point within ``radius``: the own block first, then near ones."""
    blocks = np.maximum(1, np.ceil(size / limit)).astype("int64")
    first = np.cumsum(blocks) - blocks

    def assign(batches):
        of = [list(range(f, f + n)) for f, n in zip(first.tolist(), blocks.tolist())]
        for batch in batches:
            if len(batch):
                d = distances(_matrix(batch["point"]), pivots)
                own = batch["cell"].to_numpy()
                home = first[own] + batch["deal"].to_numpy() % blocks[own]
                ring = (d <= np.minimum(extent + radius, batch["gap"].to_numpy()[:, None] + 2 * radius) * (1 + 1e-9)) & (size > 0)
                d[~ring] = np.inf
                d[np.arange(len(d)), own] = -1.0
                order, reached = d.argsort(axis=1, kind="stable"), (d < np.inf).sum(axis=1)
                visits = [[h, *[b for c in cells[:n] for b in of[c] if b != h]] for h, cells, n in zip(home.tolist(), order.tolist(), reached.tolist())]
                yield batch.drop(columns=["cell", "gap", "deal"]).assign(home=home.astype("int32"), visits=visits)

    kept = [f for f in placed.schema.fields if f.name not in ("cell", "gap", "deal")]
    return placed.mapInPandas(assign, T.StructType([*kept, T.StructField("home", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))]))


def _compared(compare: Callable[[pd.DataFrame, pd.DataFrame, Iterator[tuple]], pd.DataFrame], radii: Sequence[float], names: list[str]) -> Callable:
    entries = ENTRIES

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        return compare(a.drop(columns="point"), b.drop(columns="point"), within(_matrix(a["point"]), _matrix(b["point"]), radii, entries))

    return run


class Neighbourhoods:
    """Folded points (no, pid, point, weight), numbered and dealt to blocks, for radii that ascend.

    ``compare(points, others, pairs)`` gets what :func:`within` tells of the pairs of a slice and a block.
    """

    def __init__(self, df: DataFrame, radii: Sequence[float]):
        finite = F.forall("point", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is larger
        rows = df.select("id", _point().alias("point")).where(F.col("point").isNotNull() & finite)
        folded = rows.groupBy("point").agg(F.min("id").alias("pid"), F.count("*").alias("weight"))
        self.points = durable(folded.withColumn("no", F.monotonically_increasing_id()))
        self.radii, n = list(radii), self.points.count()
        self.empty = n == 0
        if self.empty:
            return
        pivots = np.unique(random_pivots(self.points, "point", n, BLOCK_ROWS), axis=0)
        self.limit = block_rows(n, pivots.shape[1], BLOCK_ROWS)
        placed = _at_home(self.points.select("no", "point", "weight", F.pmod(F.xxhash64("no"), F.lit(1 << 30)).alias("deal")), pivots)
        size, extent = np.zeros(len(pivots), dtype="int64"), np.zeros(len(pivots))
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect():  # one row per pivot
            size[r["cell"]], extent[r["cell"]] = r["n"], r["r"]
        self.placed = durable(_visiting(placed, pivots, extent, size, radii[-1], self.limit))
        most = self.placed.agg(F.max(F.size("visits"))).first()[0]
        early = FIRST_BLOCKS if most > FIRST_BLOCKS + FEW_MORE else most
        self.every = (0, most)
        #: Spans of the blocks that a point visits after its own
        self.spans = [(low, high) for low, high in ((1, early), (early, most)) if low < high]

    def _dealt(self, groups: int) -> int:
        """Pieces of a table whose groups are much work each: Spark may not put them together for being small."""
        spark = self.placed.sparkSession
        return max(1, min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, groups // 16)))

    def _with(self, state: DataFrame | None) -> DataFrame:
        return self.placed if state is None else self.placed.join(state, "no")

    def at_home(self, state: DataFrame | None, compare: Callable, schema: str) -> DataFrame:
        """Let the points of ``state`` (no and columns; all points without it) meet those of their own block."""
        run = _compared(compare, self.radii, [f.split()[0] for f in schema.split(", ")])
        pieces = self._dealt(self.placed.agg(F.count_distinct("home")).first()[0])
        return self._with(state).drop("visits").repartition(pieces, "home").groupBy("home").applyInPandas(lambda a: run(a, a), schema)

    def meet(self, visitors: DataFrame | None, residents: DataFrame | None, span: tuple[int, int], compare: Callable, schema: str) -> DataFrame | None:
        """Let every point of ``visitors`` meet the ``residents`` of the blocks that it visits in ``span``; None if nobody does."""
        low, high = span
        limit, own = self.limit, F.xxhash64("no", F.lit(1))  # blocks are dealt by another hash
        here = self._with(visitors).withColumn("at", F.explode(F.slice("visits", low + 1, high - low))).drop("visits", "home")
        slices = [(r["at"], math.ceil(r["n"] / limit)) for r in here.groupBy("at").agg(F.count("*").alias("n")).collect()]  # one row per block
        if not slices:
            return None
        lookup = F.broadcast(wide.rows_frame(here.sparkSession, slices, "at int, slices int"))
        left = here.join(lookup, "at").withColumn("slice", F.pmod(own, F.col("slices")).cast("int")).drop("slices")
        there = self._with(residents).drop("visits").withColumnRenamed("home", "at").join(lookup, "at")
        right = there.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides come from one table
        run = _compared(compare, self.radii, [f.split()[0] for f in schema.split(", ")])
        pieces, keys = self._dealt(sum(n for _, n in slices)), ["at", "slice"]
        return left.repartition(pieces, *keys).groupBy(*keys).cogroup(right.repartition(pieces, *keys).groupBy(*keys)).applyInPandas(run, schema)


def _connect(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that every node reaches, after the edges (a, b) are added; ``root`` tells the same of the edges before."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


class _Clusters:
    """Clusters of every case among the nodes of a task; a case is a place in ``radii`` and a minimum count."""

    def __init__(self, nodes: Sequence[int], cases: Sequence[tuple[int, int]], strictest: int):
        self.roots = [np.arange(n) for n in nodes]
        self.cases, self.order = cases, [strictest, *[c for c in range(len(cases)) if c != strictest]]

    def add(self, level: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], core: Callable[[int, np.ndarray], np.ndarray]) -> None:
        """Pairs of nodes (by case) with their level; ``core`` tells for a case which of some pairs are core on both sides."""
        left = np.arange(len(level))
        for c in self.order:
            near = left[level[left] <= self.cases[c][0]]
            near = near[core(c, near)]
            if c == self.order[0]:  # what was one cluster there before is one in every other case
                known = np.zeros(len(level), dtype=bool)
                known[near] = self.roots[c][a[c][near]] == self.roots[c][b[c][near]]
                left, near = left[~known], near[~known[near]]
            self.roots[c] = _connect(self.roots[c], a[c][near], b[c][near])


def spanning_forest(levels: np.ndarray, a: np.ndarray, b: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (row, column, level) that connect rows and columns as all entries below ``top`` do, level by level.

    ``a`` and ``b`` number the nodes of rows and columns; equal numbers are one node.
    """
    root = np.arange(int(max(a.max(), b.max())) + 1)

    def tops() -> np.ndarray:
        up = root
        while (higher := up[up]).tobytes() != up.tobytes():
            up = higher
        return up

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int, int]] = []
    for level in range(top):
        i_near, k_near = np.nonzero(levels <= level)
        while len(i_near):
            up = tops()
            apart = up[a[i_near]] != up[b[k_near]]
            i_near, k_near = i_near[apart], k_near[apart]  # what is connected stays so
            rows, first = np.unique(i_near, return_index=True)
            for i, k in zip(rows.tolist(), k_near[first].tolist()):
                x, y = find(a[i]), find(b[k])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((i, k, level))
    made = np.array(out, dtype="int64").reshape(-1, 3)
    return made[:, 0], made[:, 1], made[:, 2]


def thinned(edges: pd.DataFrame) -> pd.DataFrame:
    """Those of the edges (m, level, a, b) that connect, for every m and at every level, what all of them connect."""
    parts = []
    for _, mine in edges.groupby("m"):
        mine = mine.sort_values("level", kind="stable")
        nodes, number = np.unique(np.concatenate([mine["a"].to_numpy(), mine["b"].to_numpy()]), return_inverse=True)
        root, keep = list(range(len(nodes))), []
        for x, y in zip(number[: len(mine)].tolist(), number[len(mine) :].tolist()):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            keep.append(x != y)
            root[max(x, y)] = min(x, y)
        parts.append(mine[keep])
    return pd.concat(parts) if parts else edges


def density_labels(df: DataFrame, eps: Sequence[float], min_samples: Sequence[int]) -> DataFrame:
    """(id, labels) of (id, point): a cluster number for every radius and, inside it, every minimum count.

    Clusters count from 0 by their smallest core id, noise is -1; a border point joins the smallest cluster it touches.
    ``eps`` ascends. Rows without a point, or with null or NaN coordinates, are noise. A point counts as its own neighbour.
    """
    radii, counts = [float(e) for e in eps], [int(m) for m in min_samples]
    if sorted(set(radii)) != radii:
        raise ValueError("radii have to ascend")
    top, cases = len(radii), [(j, m) for j in range(len(radii)) for m in range(len(counts))]
    around = Neighbourhoods(df, radii)
    if around.empty:
        return df.select("id", F.array_repeat(F.lit(-1), len(cases)).alias("labels"))
    core = _cores(around, radii, counts)
    labelled = _linked(around, core, cases, max(range(len(counts)), key=lambda m: counts[m]), len(counts))
    # clusters are numbered by their smallest id
    found = _long(labelled).where(F.col("label") >= 0)
    starts = found.join(around.points.select("no", "pid"), "no").groupBy("case", "label").agg(F.min("pid").alias("root"), F.count("*").alias("cores"))
    numbered = row_numbers(durable(starts), ["root", "label"], "cluster", partition_by=["case"]).withColumn("cluster", (F.col("cluster") - 1).cast("int"))
    marked = join_back(found, durable(numbered.select("case", "label", "cluster", "cores")), ["case", "label"], "cores")
    numbers = _by_case(marked, "cluster", len(cases), _FAR)
    mine = durable(labelled.select("no").join(numbers, "no", "left").select("no", F.coalesce("labels", F.array_repeat(F.lit(_FAR), len(cases))).alias("labels")))
    names = [f"t{c}" for c in range(len(cases))]

    def touch(a: pd.DataFrame, b: pd.DataFrame, pairs: Iterator[tuple]) -> pd.DataFrame:
        own, other = np.stack(a["labels"].to_numpy()), np.stack(b["labels"].to_numpy())
        least = np.full(own.shape, _FAR, dtype="int64")
        for _, _, i, k, level in pairs:
            for c, (j, _) in enumerate(cases):
                near = (level <= j) & (own[i, c] == _FAR)
                np.minimum.at(least[:, c], i[near], other[k[near], c])
        got = (least < _FAR).any(axis=1)
        return pd.DataFrame({"no": a["no"].to_numpy()[got], **{n: least[got, c].astype("int32") for c, n in enumerate(names)}})

    some = lambda test: F.exists("labels", test)
    schema = ", ".join(["no bigint", *[f"{n} int" for n in names]])
    touched = around.meet(mine.where(some(lambda v: v == _FAR)), mine.where(some(lambda v: v < _FAR)), around.every, touch, schema)
    if touched is None:  # all points are core in every case
        final = mine
    else:
        touched = touched.groupBy("no").agg(F.array(*[F.min(n) for n in names]).alias("touched"))
        final = mine.join(touched, "no", "left")
        nearest = F.zip_with("labels", F.coalesce("touched", F.array_repeat(F.lit(_FAR), len(cases))), lambda v, t: F.least(v, t))  # core points touch nothing here
        final = final.select("no", nearest.alias("labels"))
    final = final.select("no", F.transform("labels", lambda v: F.when(v < _FAR, v).otherwise(-1)).alias("labels"))
    by_point = durable(around.points.join(final, "no").select("point", "weight", "labels"))
    rows = df.select("id", _point().alias("point"))
    return join_back(rows, by_point, ["point"], "weight", how="left").select("id", F.coalesce("labels", F.array_repeat(F.lit(-1), len(cases))).alias("labels"))


def _cores(around: Neighbourhoods, radii: Sequence[float], counts: Sequence[int]) -> DataFrame:
    """(no, first0, ...): for every minimum count the first place in ``radii`` at which a point is core, their number if at none."""
    top, most = len(radii), max(counts)
    names = [f"n{j}" for j in range(top)]

    def count(a: pd.DataFrame, b: pd.DataFrame, pairs: Iterator[tuple]) -> pd.DataFrame:
        weights, out = b["weight"].to_numpy(dtype="float64"), np.zeros((len(a), top))
        for low, high, i, k, level in pairs:
            out[low:high] += np.bincount((i - low) * top + level, weights=weights[k], minlength=(high - low) * top).reshape(-1, top)
        sums = out.cumsum(axis=1).astype("int64")
        return pd.DataFrame({"no": a["no"], **{n: sums[:, j] for j, n in enumerate(names)}})

    schema = ", ".join(["no bigint", *[f"{n} bigint" for n in names]])
    counted = durable(around.at_home(None, count, schema))
    for span in around.spans:
        near = around.meet(counted.where(F.col("n0") < most).select("no"), None, span, count, schema)
        if near is None:  # more neighbours would change nothing
            break
        counted = durable(counted.unionByName(near).groupBy("no").agg(*[F.sum(n).alias(n) for n in names]))
    too_few = lambda m: sum(((F.col(n) < m).cast("int") for n in names), F.lit(0))
    return durable(counted.select("no", *[too_few(m).alias(f"first{i}") for i, m in enumerate(counts)]))


def _linked(around: Neighbourhoods, core: DataFrame, cases: Sequence[tuple[int, int]], highest: int, counts: int) -> DataFrame:
    """(no, labels): for every case the least number of a core point's cluster, -1 where the point is not core."""
    strictest = highest  # at the smallest radius, which comes first
    firsts = [f"first{m}" for m in range(counts)]

    def at_home(a: pd.DataFrame, b: pd.DataFrame, pairs: Iterator[tuple]) -> pd.DataFrame:
        numbers, first = np.sort(a["no"].to_numpy()), a[firsts].to_numpy()
        rank = a["no"].to_numpy().argsort().argsort()
        clusters = _Clusters([len(a)] * len(cases), cases, strictest)
        for _, _, i, k, level in pairs:
            once = i < k
            i, k, level = i[once], k[once], level[once]
            x, y = rank[i], rank[k]
            clusters.add(level, [x] * len(cases), [y] * len(cases), lambda c, of, i=i, k=k: np.maximum(first[i[of], cases[c][1]], first[k[of], cases[c][1]]) <= cases[c][0])
        labels = np.stack([np.where(first[:, m] <= j, numbers[root[rank]], -1) for (j, m), root in zip(cases, clusters.roots)], axis=1)
        return pd.DataFrame({"no": a["no"], "labels": list(labels)})

    def abroad(a: pd.DataFrame, b: pd.DataFrame, pairs: Iterator[tuple]) -> pd.DataFrame:
        own, other = np.stack(a["labels"].to_numpy()), np.stack(b["labels"].to_numpy())
        nodes = [np.unique(np.concatenate([own[:, c], other[:, c]])) for c in range(len(cases))]
        x, y = ([np.searchsorted(n, side[:, c]) for c, n in enumerate(nodes)] for side in (own, other))
        clusters = _Clusters([len(n) for n in nodes], cases, strictest)
        for _, _, i, k, level in pairs:
            clusters.add(level, [u[i] for u in x], [v[k] for v in y], lambda c, of, i=i, k=k: (own[i[of], c] >= 0) & (other[k[of], c] >= 0))
        moved = [np.flatnonzero(root != np.arange(len(root))) for root in clusters.roots]
        parts = [pd.DataFrame({"case": c, "a": n[m], "b": n[root[m]]}) for c, (n, m, root) in enumerate(zip(nodes, moved, clusters.roots))]
        return pd.concat(parts)

    labelled = durable(around.at_home(core, at_home, "no bigint, labels array<bigint>"))
    visitors = cored = labelled.where(F.exists("labels", lambda v: v >= 0))
    for span in around.spans:
        edges = around.meet(visitors, cored, span, abroad, "case int, a bigint, b bigint")
        if edges is None:
            break
        labelled = _relabelled(labelled, durable(edges), len(cases))
        cored = labelled.where(F.exists("labels", lambda v: v >= 0))
        sizes = _long(cored).where(F.col("label") >= 0).groupBy("case", "label").agg(F.count("*").alias("n"))
        largest = {r["case"]: r["top"]["label"] for r in sizes.groupBy("case").agg(F.max(F.struct("n", "label")).alias("top")).collect()}
        outside = [F.col("labels")[c].isin(-1, label) for c, label in largest.items()]
        visitors = cored.where(~F.array_min(F.array(*outside))) if outside else cored.limit(0)
    return labelled


def _long(labelled: DataFrame) -> DataFrame:
    return labelled.select("no", F.posexplode("labels").alias("case", "label"))


def _by_case(rows: DataFrame, column: str, cases: int, absent: int) -> DataFrame:
    """(no, labels) of rows (no, case, column)."""
    each = [F.coalesce(F.max(F.when(F.col("case") == c, F.col(column))), F.lit(absent)) for c in range(cases)]
    return rows.groupBy("no").agg(F.array(*each).alias("labels"))


def _relabelled(labelled: DataFrame, edges: DataFrame, cases: int) -> DataFrame:
    """Labels after the edges (case, a, b) between labels are added."""
    node = lambda of: F.struct("case", F.col(of).alias("label"))
    nodes = edges.select(node("a").alias("node")).unionByName(edges.select(node("b").alias("node"))).distinct()
    found = components(nodes, edges.select(node("a").alias("a"), node("b").alias("b")))
    moved = found.where(F.col("node") != F.col("root")).select("node.case", "node.label", F.col("root.label").alias("root"))
    rows = _long(labelled)
    weighed = moved.join(rows.groupBy("case", "label").agg(F.count("*").alias("n")), ["case", "label"])
    return durable(_by_case(join_back(rows, durable(weighed), ["case", "label"], "n", how="left").select("no", "case", F.coalesce("root", "label").alias("label")), "label", cases, -1))


def dbscan_any(df: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster) of (id, point)."""
    return density_labels(df, [eps], [min_samples]).select("id", F.col("labels")[0].alias("cluster"))


def dbscan_search(df: DataFrame, eps: Sequence[float], min_samples: Sequence[int], judge: Callable[[DataFrame], float]) -> tuple[DataFrame, DataFrame]:
    """Every radius with every minimum count; the best by ``judge`` of (point, cluster), where noise is a cluster of its own.

    Returns the best assignment (id, cluster) and one row per case; a case with a single label has no score. Ties go to the
    first case. Without any score the first case is kept.
    """
    radii = sorted(set(map(float, eps)))
    labelled = durable(density_labels(df, radii, min_samples))
    cases = [(e, int(m)) for e in radii for m in min_samples]
    label = lambda i: F.col("labels")[i]
    aggregates = {f"{n}{i}": f(label(i)) for i in range(len(cases)) for n, f in (
        ("k", lambda c: F.coalesce(F.max(c), F.lit(-1)) + 1), ("noise", lambda c: F.count_if(c == -1)), ("rows", F.count))}
    got = wide.fetch(labelled, aggregates)
    usable = df.where(F.col("point").isNotNull()).join(labelled, "id").persist()
    rows, best = [], None
    for i, (e, m) in enumerate(cases):
        k, noise = got[f"k{i}"], got[f"noise{i}"]
        score = judge(usable.select("id", "point", label(i).alias("cluster"))) if k + (noise > 0) > 1 else None
        rows.append((e, m, int(k), int(noise), score))
        if score is not None and (best is None or score > best[0]):
            best = (score, i)
    usable.unpersist()
    chosen = best[1] if best else 0
    frame = wide.rows_frame(df.sparkSession, [(*r, i == chosen) for i, r in enumerate(rows)], "eps double, min_samples int, n_clusters bigint, n_noise bigint, silhouette_squared double, best boolean")
    return labelled.select("id", label(chosen).alias("cluster")), frame
