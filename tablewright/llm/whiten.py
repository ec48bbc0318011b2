"""Whitening of embeddings from the covariance of distinct vectors, weighted by how often each occurs.

Entries become whole numbers, x = floor(64 * c) + 1000000. Identical x vectors are grouped, so that every distinct vector is
centred, multiplied and whitened once; its weight in the fit is its number of rows (``weights="counts"``) or one
(``weights="one"``). Sums are exact. The covariance is a weighted product of centred vectors, block by block in the tasks; only
its dimension-by-dimension entries reach the driver. Whitened vectors are joined back to the rows by vector: those with
very many rows, whose number is bounded, through a broadcast, all others through a shuffle.

Rows whose vector is null, empty or has null or non-finite entries are dropped, and so are entries beyond 2**40 in size,
whose x would not be exact. Vectors of another length than the commonest (of equally common, the longest) are dropped
too. Repeated rows and ids count as often as they come. Components without variance (eigenvalue at most 1e-12 of the
largest one's share of the dimensions) are left out: nothing can be divided by it, so a table of equal vectors, or an
empty one, gives no rows. A deviation beyond a long is null. Only ``vec_id`` and the vector are read, so extra columns
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.plans.durable import durable

SCALE, SHIFT = 64, 1_000_000
#: Components that the query returns at most.
COMPONENTS = 32
#: Entries larger than this have no exact x.
LARGEST = float(1 << 40)
#: Vectors with at least this many rows, and at least a share of 1 / HOT_SHARES of them, are broadcast: HOT_SHARES at most.
HOT_ROWS, HOT_SHARES = 10_000, 50_000
#: Eigenvalues at most this share of the largest are rounding.
FLAT = 1e-12


@dataclass
class Fit:
    n: int  # weight of the fit list
    sums: list[int]  # of x, by dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, as columns
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: the whole part of the mean is taken away exactly."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S) ** 2, exact; None beyond a long."""
        # n x - S is at most 2 n times the largest distance from the mean's whole part, in every dimension
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = [s % self.n for s in self.sums]
        near = x - whole
        reach = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if reach * reach * max(1, x.shape[1]) < 1 << 63:
            return (((near * self.n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((near.astype(object) * self.n - np.array(rest, dtype=object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_numbers(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Key and x of the rows with a usable vector."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    rows = df.select(F.col(key), entry.alias("_c"))
    usable = F.forall("_c", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)) & ~F.isnan(c))  # NaN is above every number
    rows = rows.where(F.col("_c").isNotNull() & (F.size("_c") > 0) & F.coalesce(usable, F.lit(False)))
    x = F.transform("_c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.select(key, x.alias("x"))


def distinct(rows: DataFrame) -> DataFrame:
    """Every distinct x once, with its number of rows; only the commonest length."""
    counted = durable(rows.groupBy("x").agg(F.count("*").alias("copies")))
    sizes = counted.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("rows"))
    common = sizes.agg(F.max(F.struct("rows", "width")).alias("m")).first()["m"]
    return counted.where(F.size("x") == (common["width"] if common else 0))


def _weight(weights: str) -> str:
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    return "copies" if weights == "counts" else "1L"


def _sums(vectors: DataFrame, weight: str) -> tuple[int, list[int]]:
    """Weight of all vectors and exact sums by dimension."""
    n = vectors.agg(F.sum(F.expr(weight))).first()[0] or 0
    schema = "d int, s decimal(38, 0)"

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                times = batch.column(1).to_numpy()
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if int(np.abs(x).max()) * int(times.sum()) < 1 << 62:
                    totals = (x * times[:, None]).sum(axis=0).tolist()
                else:
                    totals = (x.astype(object) * times[:, None]).sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(totals)), type=pa.int32()), pa.array([str(t) for t in totals]).cast(pa.decimal128(38, 0))], names=["d", "s"]
                )

    partial = vectors.select("x", F.expr(weight).cast("long").alias("w")).mapInArrow(work, schema)
    # 38 digits hold the sum of 10**25 entries of the largest size
    sums = partial.groupBy("d").agg(F.sum("s").cast("decimal(38, 0)").alias("s")).orderBy("d").collect()
    return int(n), [int(r["s"]) for r in sums]


def _products(vectors: DataFrame, weight: str, width: int, rows_of) -> np.ndarray:
    """Sum over the vectors of weight * v v^T for v = rows_of(x), folded in every task and then entry by entry."""
    upper = np.triu_indices(width)

    def work(batches):
        total = np.zeros((width, width))
        for batch in batches:
            v = rows_of(batch.column(0))
            total += v.T @ (v * batch.column(1).to_numpy()[:, None])
        yield pa.RecordBatch.from_arrays([*[pa.array(u, type=pa.int32()) for u in upper], pa.array(total[upper])], names=["i", "j", "v"])

    partial = vectors.select("x", F.expr(weight).cast("long").alias("w")).mapInArrow(work, "i int, j int, v double")
    out = np.zeros((width, width))
    for r in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # one row per pair of dimensions
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit(vectors: DataFrame, weights: str = "counts", components: int | None = None) -> Fit | None:
    """Mean and components of distinct vectors (x, copies); None where there is no variance."""
    weight = _weight(weights)
    n, sums = _sums(vectors, weight)
    if not sums:
        return None
    found, width = Fit(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0), len(sums)
    covariance = _products(vectors, weight, width, lambda column: found.centred(_matrix(column, width))) / n
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    kept = int((values > max(values[0], 0) * FLAT).sum())
    kept = min(kept, components or kept)
    return Fit(n, sums, values[:kept], columns[:, :kept], float(np.trace(covariance))) if kept else None


def whitened(vectors: DataFrame, model: Fit) -> DataFrame:
    """Every distinct vector with its deviation and its whitened components."""
    width = len(model.sums)

    def work(batches):
        for batch in batches:
            x = _matrix(batch.column(0), width)
            out = model.whiten(x)
            offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.deviations(x), type=pa.int64()), lists], names=["x", "copies", "deviation", "whitened"])

    return vectors.select("x", "copies").mapInArrow(work, "x array<bigint>, copies bigint, deviation bigint, whitened array<double>")


def identity_error(done: DataFrame, model: Fit, weights: str = "counts") -> float:
    """Largest absolute entry of the covariance of whitened vectors minus the identity, measured on the vectors themselves."""
    weight, width = _weight(weights), len(model.values)
    means = done.select(F.expr(weight).alias("w"), F.posexplode("whitened").alias("d", "v")).groupBy("d").agg((F.sum(F.col("w") * F.col("v")) / model.n).alias("m"))
    mean = np.array([r["m"] for r in means.orderBy("d").collect()])
    vectors = done.select(F.col("whitened").alias("x"), "copies")
    covariance = _products(vectors, weight, width, lambda column: _matrix(column, width) - mean) / model.n
    return float(np.abs(covariance - np.eye(width)).max())


def join_back(rows: DataFrame, done: DataFrame, total: int) -> DataFrame:
    """Rows (key, x) with what their distinct vector has got."""
    least = max(HOT_ROWS, total // HOT_SHARES)
    key = F.xxhash64("x").alias("_h")  # sorted by a number first, then by the vector
    rows, done = rows.select("*", key), done.select("*", key)
    hot, cold = done.where(F.col("copies") >= least), done.where(F.col("copies") < least)
    few = F.broadcast(hot.drop("copies"))  # HOT_SHARES vectors at most
    often = rows.join(few, ["_h", "x"])
    rest = rows.join(F.broadcast(hot.select("_h", "x")), ["_h", "x"], "left_anti")
    return often.unionByName(rest.join(cold.drop("copies").hint("shuffle_merge"), ["_h", "x"])).drop("_h")


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", weights: str = "counts", components: int | None = None) -> tuple[DataFrame | None, Fit | None, float | None]:
    """Rows (key, deviation, whitened), the fit, and the error of the whitened covariance; None without variance."""
    rows = whole_numbers(df, vector, key)
    vectors = durable(distinct(rows))
    model = fit(vectors, weights, components)
    if model is None:
        return None, None, None
    done = durable(whitened(vectors, model))
    total = done.agg(F.sum("copies")).first()[0]
    return join_back(rows, done, total).drop("x"), model, identity_error(done, model, weights)


def query(embeddings: DataFrame) -> DataFrame:
    """One row per vector and component."""
    schema = T.StructType().add("vec_id", embeddings.schema["vec_id"].dataType).add("component", "integer").add("n", "long").add("deviation", "long")
    for name in ("whitened", "explained", "identity_error"):
        schema = schema.add(name, "double")
    rows, model, error = whiten(embeddings, components=COMPONENTS)
    if rows is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    flat = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
