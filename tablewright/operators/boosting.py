"""Boosting of several classes by softmax: one ensemble, a tree for every class in every round.

Features are cut into bins once. Rows of one class whose bins are equal get the same scores in every round, so they are folded
into one with a weight, unless every round draws rows of its own. Rows keep their bins and the scores of all classes; a scan per
level of the trees adds up rows, residuals and curvature by class, node, feature and bin, so all trees of a round grow together.
The driver sees these sums, whose number is bounded by the trees and not by the rows, and picks the splits. Scores are written
anew every ``REFRESH`` rounds; between, tasks add the trees since then.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.plans.durable import durable

BINS = 32
#: Rows drawn at random for the borders of the bins.
BORDER_ROWS = 20_000
REFRESH = 10
#: Sums of one scan; more are taken in several, feature by feature.
SUMS_AT_ONCE = 4_000_000
#: Rows that a task folds before it passes them on.
FOLD_ROWS = 100_000
#: Rows of a piece of the folded table while there are fewer pieces than cores, and beyond.
PIECE_ROWS, MOST_PIECE_ROWS = 20_000, 250_000
#: Cells of the borders whose scores a task remembers.
CELLS_KEPT = 200_000
STATE = "label int, draw double, weight double, bins binary, scores binary"


@dataclass
class Tree:
    """A binary tree in heap order; ``feature`` is -1 at leaves. Values below or at the border go left."""

    feature: list[int]
    border: list[float]
    bin: list[int]
    value: list[float]

    def places(self, binned: np.ndarray) -> np.ndarray:
        """Node of every row of bins."""
        feature, cut = np.array(self.feature), np.array(self.bin)
        at = np.zeros(len(binned), dtype=np.int64)
        while True:
            own = feature[at]
            inner = own >= 0
            if not inner.any():
                return at
            left = binned[np.arange(len(at)), np.maximum(own, 0)] <= cut[at]
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Value of every row of features."""
        feature, border, value = np.array(self.feature), np.array(self.border), np.array(self.value)
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            own = feature[at]
            inner = own >= 0
            if not inner.any():
                return value[at]
            left = x[np.arange(len(at)), np.maximum(own, 0)] <= border[at]
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of every row of a matrix."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype="int32") * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _folded(parts: list[pa.Table]) -> pa.Table:
    """Rows (label, bins, weight) with equal label and bins as one."""
    found = pa.concat_tables(parts).group_by(["label", "bins"]).aggregate([("weight", "sum")])
    return found.rename_columns({"weight_sum": "weight"}).select(["label", "bins", "weight"])


def _bytes_matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


class SoftmaxBoosting(Estimator):
    """Multinomial deviance, trees of equal depth limit, leaves by one Newton step."""

    def __init__(self, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, subsample: float = 1.0, min_leaf: int = 1, classes: int = 3, seed: int = 42):
        super().__init__()
        self.rounds, self.rate, self.depth = int(n_estimators), float(learning_rate), int(max_depth)
        self.subsample, self.min_leaf, self.classes, self.seed = float(subsample), int(min_leaf), int(classes), seed

    def _borders(self, df: DataFrame) -> list[np.ndarray]:
        """Upper borders of all bins but the last, by feature; every value has a bin of its own where there are few."""
        n = df.count()
        sample = df.select(vector_to_array("features").alias("x")).sample(min(1.0, 1.2 * BORDER_ROWS / max(n, 1)), self.seed).limit(BORDER_ROWS)
        x = np.array([r["x"] for r in sample.collect()])
        out = []
        for column in x.T:
            values = np.unique(column)
            if len(values) > BINS:
                values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf"))
                out.append(values)
            else:
                out.append((values[:-1] + values[1:]) / 2)
        return out

    def _fit(self, df: DataFrame) -> SoftmaxBoostingModel:
        borders, k = self._borders(df), self.classes
        counts = {int(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
        total = sum(counts.values())
        start = np.log(np.maximum([counts.get(c, 0) / total for c in range(k)], 1e-12))
        model = SoftmaxBoostingModel(start.tolist(), self.rate, [], [], len(borders))

        state = self._started(df, borders, start)
        for r in range(self.rounds):
            model.rounds.append(self._round(state, model.rounds[r - r % REFRESH :], r, borders, model))
            if (r + 1) % REFRESH == 0 and r + 1 < self.rounds:
                state = self._kept(self._advanced(state, model.rounds[-REFRESH:], len(borders)))
        return model

    def _started(self, df: DataFrame, borders: list[np.ndarray], start: np.ndarray) -> DataFrame:
        """Rows (:data:`STATE`) with the scores of the start; folded where all rounds take all rows."""

        def binned(batch: pa.RecordBatch) -> pa.Array:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            return _binary(np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(borders)], axis=1).astype(np.uint8))

        def fold(batches):
            parts, held = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                ones = pa.array(np.ones(batch.num_rows, dtype="int64"))
                parts.append(_folded([pa.table([batch.column(0), binned(batch), ones], names=["label", "bins", "weight"])]))
                held += parts[-1].num_rows
                if held > FOLD_ROWS:
                    parts = [_folded(parts)]
                    held = parts[0].num_rows
                    if held > FOLD_ROWS // 2:  # too many to keep: Spark folds the rest
                        yield from parts[0].to_batches()
                        parts, held = [], 0
            if parts:
                yield from _folded(parts).to_batches()

        def begin(batches):
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                weight, bins = (batch.column(3).cast(pa.float64()), batch.column(1)) if folding else (pa.array(np.ones(n)), binned(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), weight, bins, _binary(np.tile(start, (n, 1)))], names=["label", "draw", "weight", "bins", "scores"])

        folding = self.subsample >= 1
        rows = df.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))
        if not folding:
            return self._kept(rows.withColumn("draw", F.rand(self.seed)).mapInArrow(begin, STATE))
        parts = rows.mapInArrow(fold, "label int, bins binary, weight bigint")
        few = durable(parts.groupBy("label", "bins").agg(F.sum("weight").alias("weight")))
        n, cores = few.count(), df.sparkSession.sparkContext.defaultParallelism
        pieces = max(1, min(cores, math.ceil(n / PIECE_ROWS)), math.ceil(n / MOST_PIECE_ROWS))
        return self._kept(few.repartition(pieces).select("label", "bins", F.lit(0.0).alias("draw"), "weight").mapInArrow(begin, STATE))

    def _kept(self, state: DataFrame) -> DataFrame:
        """The rows written; notes in how many pieces they are read."""
        state = durable(state)
        self.pieces = state.rdd.getNumPartitions()
        return state

    def _advanced(self, state: DataFrame, recent: list[list[Tree]], width: int) -> DataFrame:
        k, rate = self.classes, self.rate

        def add(batches):
            for batch in batches:
                scores = _scored(batch, recent, width, k, rate)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], _binary(scores)], names=batch.schema.names)

        return state.mapInArrow(add, STATE)

    def _round(self, state: DataFrame, recent: list[list[Tree]], number: int, borders: list[np.ndarray], model: SoftmaxBoostingModel) -> list[Tree]:
        """One tree per class, grown level by level."""
        k, width, nodes = self.classes, len(borders), 2 ** (self.depth + 1) - 1
        trees = [Tree([-1] * nodes, [0.0] * nodes, [0] * nodes, [0.0] * nodes) for _ in range(k)]
        for level in range(self.depth):
            first, many = 2**level - 1, 2**level
            sums = self._sums(state, recent, trees, number, width, first, many)
            split_any = False
            for c in range(k):
                for node in range(first, first + many):
                    own = sums[c, node - first]  # feature, bin, (rows, residuals, curvature)
                    whole = own[0].sum(axis=0)
                    if level == 0:
                        trees[c].value[0] = self._leaf(whole)
                    if whole[0] < 2 * self.min_leaf:
                        continue
                    left = own.cumsum(axis=1)[:, :-1]
                    right = whole - left
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[1] ** 2 / whole[0]
                    gain = np.where((left[..., 0] >= self.min_leaf) & (right[..., 0] >= self.min_leaf), gain, -np.inf)
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if not gain[j, b] > 1e-12 * max(1.0, whole[0]):
                        continue
                    split_any = True
                    trees[c].feature[node], trees[c].bin[node], trees[c].border[node] = int(j), int(b), float(borders[j][b])
                    trees[c].value[2 * node + 1], trees[c].value[2 * node + 2] = self._leaf(left[j, b]), self._leaf(right[j, b])
                    model.gains[int(j)] = model.gains.get(int(j), 0.0) + float(gain[j, b])
            if not split_any:
                break
        return trees

    def _leaf(self, sums: np.ndarray) -> float:
        """Newton step of the multinomial deviance."""
        return float((self.classes - 1) / self.classes * sums[1] / sums[2]) if sums[2] > 1e-150 else 0.0

    def _sums(self, state: DataFrame, recent: list[list[Tree]], trees: list[Tree], number: int, width: int, first: int, many: int) -> np.ndarray:
        """Rows, residuals and curvature of every class, node, feature and bin."""
        k, rate, share = self.classes, self.rate, self.subsample
        at_once = max(1, SUMS_AT_ONCE // (k * many * BINS))
        out = np.zeros((k, many, width, BINS, 3))
        for low in range(0, width, at_once):
            chosen = range(low, min(width, low + at_once))

            def add(batches, chosen=chosen):
                total = np.zeros((3, k * many * len(chosen) * BINS))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    bins, weight = _bytes_matrix(batch.column(3), "uint8", width), batch.column(2).to_numpy()
                    p = softmax(_scored(batch, recent, width, k, rate))
                    label = batch.column(0).to_numpy()
                    taken = np.ones(len(label), dtype=bool)
                    if share < 1:  # another part of the rows every round
                        taken = (batch.column(1).to_numpy() * 7919 + number * 0.6180339887498949) % 1 < share
                    for c in range(k):
                        residual = (label == c) - p[:, c]
                        curve = np.abs(residual) * (1 - np.abs(residual))
                        node = trees[c].places(bins) - first
                        mine = np.flatnonzero(taken & (node >= 0))
                        slot = ((c * many + node[mine])[:, None] * len(chosen) + np.arange(len(chosen))) * BINS + bins[mine][:, chosen.start : chosen.stop]
                        for i, v in enumerate((weight[mine], (weight * residual)[mine], (weight * curve)[mine])):
                            total[i] += np.bincount(slot.ravel(), weights=np.repeat(v, len(chosen)), minlength=total.shape[1])
                held = np.flatnonzero(total[0])
                yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(t[held]) for t in total]], names=["i", "n", "r", "h"])

            partial = state.mapInArrow(add, "i bigint, n double, r double, h double")
            slots = k * many * len(chosen) * BINS
            if self.pieces * slots > SUMS_AT_ONCE // 10:  # few sums of few pieces are added on the driver, others by a shuffle
                partial = partial.groupBy("i").agg(*[F.sum(x).alias(x) for x in ("n", "r", "h")])
            found = partial.toArrow()
            at = found.column("i").to_numpy()
            flat = np.stack([np.bincount(at, weights=found.column(x).to_numpy(), minlength=slots) for x in ("n", "r", "h")], axis=1)
            out[:, :, low : low + len(chosen)] = flat.reshape(k, many, len(chosen), BINS, 3)
        return out


def _scored(batch: pa.RecordBatch, recent: list[list[Tree]], width: int, k: int, rate: float) -> np.ndarray:
    scores = _bytes_matrix(batch.column(4), "float64", k).copy()
    if recent:
        bins = _bytes_matrix(batch.column(3), "uint8", width)
        for trees in recent:
            for c, tree in enumerate(trees):
                scores[:, c] += rate * np.array(tree.value)[tree.places(bins)]
    return scores


@dataclass
class _Shape:
    start: list[float]
    rate: float
    rounds: list[list[Tree]]
    width: int
    gains: dict[int, float] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of all classes for every row of features."""
        scores = np.tile(np.array(self.start), (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                scores[:, c] += self.rate * tree.scores(x)
        return scores

    def borders(self) -> list[tuple[int, np.ndarray]]:
        """The features that the trees look at and all their borders; rows between the same ones score alike."""
        used: dict[int, set[float]] = {}
        for tree in (t for trees in self.rounds for t in trees):
            for j, b in zip(tree.feature, tree.border):
                if j >= 0:
                    used.setdefault(j, set()).add(b)
        return [(j, np.array(sorted(used[j]))) for j in sorted(used)]

    def scored(self, batches: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """:meth:`scores` of batch after batch; the trees are walked once for all rows of a cell of the borders, as long as it is remembered."""
        borders = self.borders()
        if math.prod(len(b) + 1 for _, b in borders) >= 2**62:
            yield from map(self.scores, batches)
            return
        known, answers = np.empty(0, dtype="int64"), np.empty((0, len(self.start)))
        for x in batches:
            cell = np.zeros(len(x), dtype="int64")
            for j, b in borders:
                cell = cell * (len(b) + 1) + np.searchsorted(b, x[:, j], side="left")
            cells, first, back = np.unique(cell, return_index=True, return_inverse=True)
            new = ~np.isin(cells, known, assume_unique=True)
            if len(known) + new.sum() > CELLS_KEPT:
                known, answers, new = known[:0], answers[:0], np.ones(len(cells), dtype=bool)
            if new.any():
                known = np.concatenate([known, cells[new]])
                answers = np.concatenate([answers, self.scores(x[first[new]])])
                order = known.argsort()
                known, answers = known[order], answers[order]
            yield answers[np.searchsorted(known, cells)][back]


class SoftmaxBoostingModel(Transformer):
    """Adds rawPrediction, probability and prediction."""

    def __init__(self, start: list[float], rate: float, rounds: list[list[Tree]], gains: list | dict, width: int):
        super().__init__()
        self.start, self.rate, self.rounds, self.width = start, rate, rounds, width
        self.gains: dict[int, float] = dict(gains)

    @property
    def featureImportances(self):  # noqa: N802  as MLlib names it
        total = sum(self.gains.values()) or 1.0
        return Vectors.sparse(self.width, {j: g / total for j, g in sorted(self.gains.items())})

    def _transform(self, df: DataFrame) -> DataFrame:
        shape = _Shape(self.start, self.rate, self.rounds, self.width)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            values = (np.array(x.tolist(), dtype="float64").reshape(len(x), shape.width) for x in batches)
            for scores in shape.scored(values):
                yield pd.Series(list(scores))

        out = df.withColumn("_raw", raw(vector_to_array("features")))
        top = F.array_max("_raw")
        powers = F.transform("_raw", lambda v: F.exp(v - top))
        whole = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
        return out.withColumns(
            {
                "rawPrediction": array_to_vector("_raw"),
                "probability": array_to_vector(F.transform(powers, lambda v: v / whole)),
                "prediction": (F.array_position("_raw", top) - 1).cast("double"),
            }
        ).drop("_raw")

    def write(self) -> _Writer:
        return _Writer(self)

    @staticmethod
    def load(path: str) -> SoftmaxBoostingModel:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/settings").first()[0])
        rows = spark.read.parquet(f"{path}/trees").orderBy("round", "class").collect()
        rounds: list[list[Tree]] = [[] for _ in range(meta["rounds"])]
        for r in rows:
            rounds[r["round"]].append(Tree(r["feature"], r["border"], r["bin"], r["value"]))
        return SoftmaxBoostingModel(meta["start"], meta["rate"], rounds, {int(j): g for j, g in meta["gains"].items()}, meta["width"])


@dataclass
class _Writer:
    model: SoftmaxBoostingModel

    def save(self, path: str) -> None:
        m, spark = self.model, SparkSession.getActiveSession()
        meta = {"start": m.start, "rate": m.rate, "rounds": len(m.rounds), "gains": m.gains, "width": m.width}
        spark.createDataFrame([(json.dumps(meta),)], "settings string").coalesce(1).write.text(f"{path}/settings")
        rows = [(r, c, t.feature, t.border, t.bin, t.value) for r, trees in enumerate(m.rounds) for c, t in enumerate(trees)]
        schema = "round int, class int, feature array<int>, border array<double>, bin array<int>, value array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/trees")
