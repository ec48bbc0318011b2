"""Near-duplicate embeddings by NN-descent.

1. Start: vectors of a label fall into leaves by the signs of random projections, several times over; each takes its
   nearest ones of the same leaf as neighbours.
2. Descent: all vectors that are neighbours of one vector, in either direction, are compared; who is nearer than the last
   of a list enters it. This goes on until the lists hardly improve.
3. Saturated lists, whose last entry still is near the threshold, are enlarged and refined again, until the families that the
   near entries form no longer change. Lists that still are saturated may hold near copies only and tell nothing of the next
   family: families with such lists are cut into balls, and those with balls that can reach each other are joined.
4. Families are compared whole in double precision, large ones block by block: these give the links.

Steps 1 and 2 use vectors rounded to bytes; steps 1 to 3 only propose, step 4 decides. ``audit`` compares with brute force over a set
of queries and gives the recall.

Only vectors of equal, non-null labels and equal length are compared. Null vectors and those that are zero or hold null or
non-finite components link with nothing and are their own component. Equal directions form one class, of which one vector
takes part; the others share its links. Rows with the same id count as one vector in components and one by one in links.
Null ids come last, count as one in components, and stay null. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm import twins
from tablewright.llm.components import components
from tablewright.plans.durable import durable

THRESHOLD = 0.98
#: Neighbours at the start, trees, size of leaves and of compared lists, and rounds at most.
NEIGHBOURS, TREES, LEAF, LIST, ROUNDS = 12, 4, 48, 128, 8
#: Similarity lost by rounding to bytes, at most.
MARGIN = 0.03
#: A round must better the mean similarity of the lists by this.
GAIN = 1e-3
#: Vectors that meet in one task.
TASK_ROWS = 4096


def unit_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``id``, ``cell`` (label and length, null if the vector links with nothing), ``unit`` (doubles) and ``small`` (bytes)."""

    def work(batches):
        for batch in batches:
            ids, cells, units, smalls = batch.column(0), [], [], []
            for vector, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.array([np.nan if v is None else v for v in vector or []], dtype=np.float64)
                most = np.abs(x).max() if len(x) else 0.0
                if name is None or not np.isfinite(most) or most == 0:
                    cells.append(None)
                    units.append(None)
                    smalls.append(None)
                    continue
                x = x / most
                x /= np.sqrt(x @ x)
                cells.append(f"{name}/{len(x)}")
                units.append(x.tobytes())
                smalls.append(np.rint(x * 127 / np.abs(x).max()).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(cells, pa.string()), pa.array(units, pa.binary()), pa.array(smalls, pa.binary())], names=["id", "cell", "unit", "small"])

    rows = df.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(twins.NO_ID)).alias("id"), embedding, F.col(label).cast("string").alias("label"))
    return rows.mapInArrow(work, "id bigint, cell string, unit binary, small binary")


def _matrix(parts: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1).astype(np.float32 if kind == "i1" else np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if kind == "i1" else x


def _compare(rows: DataFrame, neighbours: int | None) -> DataFrame:
    """``src``, ``dst``, ``sim`` of the vectors that meet in a ``place``; at most LIST of them at once, dealt by hash.

    neighbours: keep that many for each; None: keep those above ``bar``.
    """
    total = rows.count()
    bins = max(1, total // 2048)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("turn", "ascending")])
        place, ids = table.column("place").to_numpy(), table.column("id").to_numpy()
        small, bar = table.column("small").to_pylist(), table.column("bar").to_numpy()
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        out: list[tuple[np.ndarray, ...]] = []
        for begin, end in zip(cuts[:-1], cuts[1:]):
            parts = -(-(end - begin) // LIST)
            borders = np.linspace(begin, end, parts + 1).astype(int).tolist()
            for low, high in zip(borders[:-1], borders[1:]):
                x = _matrix(small[low:high], "i1")
                near, own = x @ x.T, ids[low:high]
                np.fill_diagonal(near, -2)
                near[own[:, None] == own[None, :]] = -2
                if neighbours is None:
                    a, b = np.nonzero(near > bar[low:high, None])
                elif high - low > neighbours + 1:
                    b = np.argpartition(-near, neighbours, axis=1)[:, :neighbours]
                    a = np.repeat(np.arange(high - low), neighbours)
                    b = b.ravel()
                else:
                    a, b = np.nonzero(near > -1.5)
                out.append((own[a], own[b], near[a, b]))
        src, dst, sim = (np.concatenate(c) for c in zip(*out))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(sim, pa.float32())})

    dealt = rows.withColumn("turn", F.xxhash64("id", "place")).withColumn("bin", F.pmod("place", F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(work, "src bigint, dst bigint, sim float")


def _nearest(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """The best entries of every list, as long as the list may be."""
    best = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim")).join(lists, "src")
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("room")).drop("rank")


def _start(reps: DataFrame) -> DataFrame:
    sizes = reps.groupBy("cell").agg(F.count("*").alias("members"))

    def work(batches):
        for batch in batches:
            out = []
            names = batch.schema.names
            for row in zip(*[batch.column(names.index(n)).to_pylist() for n in ("id", "cell", "small", "members")]):
                ident, cell, small, members = row
                x = np.frombuffer(small, dtype=np.int8).astype(np.float32)
                bits = max(0, int(np.ceil(np.log2(members / LEAF)))) if members > LEAF else 0
                for tree in range(TREES if bits else 1):
                    signs = (_planes(tree, len(x), bits) @ x > 0) if bits else []
                    out.append((ident, small, f"{cell}/{tree}/" + "".join("1" if s else "0" for s in signs)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.string()))] if out else [pa.array([], k) for k in (pa.int64(), pa.binary(), pa.string())], names=["id", "small", "leaf"])

    leaves = reps.join(sizes, "cell").select("id", "cell", "small", "members").mapInArrow(work, "id bigint, small binary, leaf string")
    return durable(leaves.select("id", "small", F.xxhash64("leaf").alias("place"), F.lit(0.0).cast("float").alias("bar")))


_PLANES: dict[tuple[int, int, int], np.ndarray] = {}


def _planes(tree: int, width: int, bits: int) -> np.ndarray:
    if (tree, width, bits) not in _PLANES:
        _PLANES[tree, width, bits] = np.random.Generator(np.random.PCG64([tree, width])).standard_normal((bits, width)).astype(np.float32)
    return _PLANES[tree, width, bits]


def _refine(graph: DataFrame, reps: DataFrame) -> DataFrame:
    """One round: neighbours of the same vector are compared."""
    full = graph.groupBy("src").agg(F.count("*").alias("n"), F.min("sim").alias("last"), F.first("room").alias("room"))
    bars = full.select(F.col("src").alias("id"), F.when(F.col("n") >= F.col("room"), F.col("last")).otherwise(F.lit(-1.0).cast("float")).alias("bar"))
    vectors = reps.select("id", "small").join(bars, "id", "left").select("id", "small", F.coalesce("bar", F.lit(-1.0).cast("float")).alias("bar"))
    meet = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    meet = durable(meet.select(F.col("src").alias("place"), F.col("dst").alias("id")).join(vectors, "id"))
    lists = graph.select("src", "room").distinct()
    return durable(_nearest(graph.select("src", "dst", "sim").unionByName(_compare(meet, None)), lists))


def descend(reps: DataFrame, threshold: float) -> DataFrame:
    """Near entries (``a``, ``b``) of the refined lists."""
    lists = reps.select(F.col("id").alias("src"), F.lit(NEIGHBOURS).alias("room"))
    graph = durable(_nearest(_compare(_start(reps), NEIGHBOURS), lists))
    mean = graph.agg(F.avg("sim")).first()[0]
    if mean is None:
        return graph.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for _ in range(ROUNDS):
        graph = _refine(graph, reps)
        now = graph.agg(F.avg("sim")).first()[0]
        if now - mean < GAIN:
            break
        mean = now
    near, families = F.col("sim") >= threshold - MARGIN, None
    while True:
        links = graph.where(near).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        found = components(links).select("component").distinct().count()
        full = graph.where(near).groupBy("src").agg(F.count("*").alias("n"), F.first("room").alias("room")).where("n >= room").select("src")
        full = durable(full.withColumn("full", F.lit(True)))
        if not full.take(1):
            return links
        if found == families:
            return links.unionByName(reaching(reps, links, full, threshold))
        families = found
        graph = graph.join(full, "src", "left").withColumn("room", F.when(F.col("full"), F.col("room") * 4).otherwise(F.col("room"))).drop("full")
        graph = _refine(durable(graph), reps)


def _dealt(rows: DataFrame, key: str, task_rows: int, pairs: bool = True) -> DataFrame:
    """Add ``block`` and ``task``: small groups of ``key`` share tasks, large ones are cut into blocks of half a task.

    pairs: every two blocks of a group meet in a task, so that rows of large groups come several times.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("members"))
    total = sizes.agg(F.sum("members")).first()[0] or 0
    tasks = max(1, -(-2 * total // task_rows))
    half = task_rows // 2
    sizes = sizes.select(key, F.ceil(F.col("members") / half).cast("int").alias("blocks"))
    rows = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    small = F.array(F.concat_ws("-", F.lit("s"), F.pmod(F.xxhash64(key), F.lit(tasks))))
    alone = F.array(F.concat_ws("-", key, "block"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.concat_ws("-", key, F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
    return rows.withColumn("task", F.explode(F.when(F.col("blocks") == 1, small).otherwise(met if pairs else alone))).drop("blocks")


def _cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every run of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:]))


def reaching(reps: DataFrame, near: DataFrame, full: DataFrame, threshold: float, task_rows: int = TASK_ROWS) -> DataFrame:
    """``a``, ``b``: links that join the families with saturated lists (``src`` of full) whose members can be linked.

    A ball is a block of a family, with its centre and the largest angle to it. By the triangle inequality members of two balls
    are linked only if the angle of the centres is at most both radii and the angle of the threshold. All balls of a cell meet.
    """
    family = durable(components(near))
    chosen = family.join(full.select(F.col("src").alias("node")), "node", "left_semi").select("component").distinct()
    members = family.join(durable(chosen), "component", "left_semi")
    rows = _dealt(reps.select("id", "cell", "unit").join(members.withColumnRenamed("node", "id"), "id"), "component", task_rows, pairs=False)

    def balls(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("id", "ascending")])
        ids, cell, unit = table.column("id").to_numpy(), table.column("cell").to_pylist(), table.column("unit").to_pylist()
        out = []
        for begin, end in _cuts(table.column("component").to_numpy()):
            x = _matrix(unit[begin:end], "f8")
            centre = x.sum(axis=0)
            length = np.sqrt(centre @ centre)
            centre = centre / length if length > 1e-6 else x[0]
            out.append((ids[begin], cell[begin], centre.tobytes(), float(np.arccos(np.clip(x @ centre, -1, 1)).max())))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.binary(), pa.float64()))], names=["id", "cell", "centre", "radius"])

    found = durable(rows.groupBy("task").applyInArrow(balls, "id bigint, cell string, centre binary, radius double"))
    limit = np.arccos(threshold) + 1e-6

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("id", "ascending")])
        ids, radius, centre = table.column("id").to_numpy(), table.column("radius").to_numpy(), table.column("centre").to_pylist()
        roots = np.arange(len(ids))
        for begin, end in _cuts(np.array(table.column("cell").to_pylist())):
            x, left = _matrix(centre[begin:end], "f8"), np.ones(end - begin, dtype=bool)
            for first in range(end - begin):
                if not left[first]:
                    continue
                left[first], todo = False, np.array([first])
                while len(todo):
                    now, todo = todo[:256], todo[256:]
                    rest = np.flatnonzero(left)
                    angle = np.arccos(np.clip(x[now] @ x[rest].T, -1, 1))
                    met = rest[(angle <= radius[begin + now][:, None] + radius[begin + rest][None, :] + limit).any(axis=0)]
                    left[met], roots[begin + met] = False, begin + first
                    todo = np.concatenate([todo, met])
        return pa.table({"a": pa.array(ids), "b": pa.array(ids[roots])})

    met = _dealt(found, "cell", task_rows).groupBy("task").applyInArrow(work, "a bigint, b bigint")
    return durable(met.where("a <> b"))


def links(reps: DataFrame, near: DataFrame, threshold: float, task_rows: int = TASK_ROWS) -> DataFrame:
    """``a``, ``b`` (enough links to hold the linked ones together, a = b for the rest) and ``links`` of a, from whole families."""
    family = durable(components(near))
    rows = _dealt(reps.select("id", "unit", "weight").join(family.withColumnRenamed("node", "id"), "id"), "component", task_rows)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("id", "ascending")])
        ids, weight, block = (table.column(n).to_numpy() for n in ("id", "weight", "block"))
        family, unit, task = table.column("component").to_numpy(), table.column("unit").to_pylist(), table.column("task")[0].as_py()
        apart = not task.startswith("s-") and task.rsplit("-", 2)[1] != task.rsplit("-", 2)[2]
        root, found = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for begin, end in _cuts(family):
            x = _matrix(unit[begin:end], "f8")
            for low in range(begin, end, 256):
                high = min(end, low + 256)
                linked = x[low - begin : high - begin] @ x.T >= threshold
                linked[np.arange(high - low), np.arange(low - begin, high - begin)] = False
                if apart:
                    linked &= block[low:high, None] != block[None, begin:end]
                found[low:high] += linked @ weight[begin:end]
                for k in range(low, high):
                    for other in np.unique([top(j) for j in (begin + np.flatnonzero(linked[k - low])).tolist()]).tolist():
                        a, b = sorted((top(k), top(other)))
                        root[b] = a
        roots = ids[[top(k) for k in range(len(ids))]] if len(ids) else ids
        return pa.table({"a": pa.array(ids), "b": pa.array(roots), "links": pa.array(found)})

    return durable(rows.groupBy("task").applyInArrow(work, "a bigint, b bigint, links bigint"))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per vector ``vec_id``, ``n_links``, ``component_id`` and ``kept`` (the smallest id of its component)."""
    vectors = durable(unit_vectors(df, vec_id, embedding, label))
    key = ["cell", "one", "two"]
    marked = vectors.withColumns({"one": F.xxhash64("unit"), "two": F.xxhash64(F.lit("second"), "unit")})
    classes = marked.where("cell IS NOT NULL").groupBy(*key).agg(F.min("id").alias("class"), F.count("*").alias("weight"), F.min_by("unit", "id").alias("unit"), F.min_by("small", "id").alias("small"))
    classes = durable(classes)
    reps = classes.select(F.col("class").alias("id"), "cell", "unit", "small", "weight").dropDuplicates(["id"])
    reps = durable(reps)
    found = links(reps, descend(reps, threshold), threshold)
    linked = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    component = components(found).withColumnRenamed("node", "class")
    rows = marked.select("id", *key).join(classes.select(*key, "class", "weight"), key, "left").join(linked, "class", "left").join(component, "class", "left")
    own = F.coalesce("component", "class", "id")
    return rows.select(
        F.nullif("id", F.lit(twins.NO_ID)).alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"),
        F.nullif(own, F.lit(twins.NO_ID)).alias("component_id"), (F.col("id") == own).alias("kept"),
    )


def audit(df: DataFrame, found: DataFrame, every: int = 50, threshold: float = THRESHOLD) -> float:
    """Recall of links for the vectors whose id is divisible by ``every``, against brute force in blocks over all rows."""
    vectors = unit_vectors(df).where("cell IS NOT NULL")
    blocks = max(1, -(-vectors.count() // 4096))
    queries = vectors.where(F.col("id") % every == 0).select("id", "cell", "unit", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
    rows = vectors.select("id", "cell", "unit", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))

    def work(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        x = _matrix(table.column("unit").to_pylist(), "f8")
        linked = (x[asks] @ x[~asks].T >= threshold) & (ids[asks][:, None] != ids[~asks][None, :])
        return pa.table({"id": pa.array(ids[asks]), "n": pa.array(linked.sum(axis=1).astype(np.int64))})

    true = queries.unionByName(rows).groupBy("cell", "block").applyInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    got = true.join(found.select(F.col("vec_id").alias("id"), "n_links"), "id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return (got[1] or 0) / got[0] if got[0] else 1.0


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
         AND len(list_filter(x, lambda c: c <> 0)) > 0),
edge AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
         WHERE list_cosine_similarity(p.x, q.x) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM edge GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN n USING (vec_id)
"""
