"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - weights . features): one weight vector over hashed text features, shared by all
grades, and ordered thresholds between them. It gives the expected grade and the tail probability of the best grades,
by which documents are selected.

Features are the distinct tokens of a text: runs of letters in lower case, runs of punctuation, digits as one token,
a mark for words in capitals and one for how varied the tokens are, hashed into ``BUCKETS``. Buckets met in fewer than
``MIN_ROWS`` ratings get no weight; the others are scaled by how differently they occur below and above some grade, so
that the penalty on the weights holds back chance words and not telling ones.
The fit takes at most about ``SAMPLE_ROWS`` ratings, chosen by hash; each step sums gradients over partitions in Spark
and only the vectors of the buckets in use come to the driver. Every document is scored.

A document is rejected if its tail probability is below ``cut``, which keeps ``KEEP_GOOD`` of the best ratings of a fifth that
the fit does not see, but never above the probability of a document of which nothing is known: only what speaks against a
document rejects it, not the mix of the grades.

Ratings with a null grade or without a document are not used; several ratings of one document all count. Without
ratings, or with ratings of one grade only, nothing is rejected: grade and probability are null. Null texts count as empty;
these and texts none of whose words has a weight have no features and stay. Repeated rows are scored alike. Extra columns pass through unless called like a result column.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.arrow import columns_of, shares, with_fields
from tablewright.plans.durable import durable

BUCKETS, SAMPLE_ROWS, MIN_ROWS, PENALTY, STEPS = 1 << 18, 50_000, 5, 1e-3, 25
#: Share of the best ratings that stay, and how many of them a fifth must hold to be set apart for the cut.
KEEP_GOOD, MIN_HELD = 0.99, 20

TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+|[\d_]+")
#: Tokens that a task remembers; later ones are worked out whenever they come.
CACHED_TOKENS = 60_000
_CACHE: dict[str, int] = {}
CAPITALS, DIGITS = zlib.crc32(b"\x00capitals") % BUCKETS, zlib.crc32(b"\x00digits") % BUCKETS


#: Buckets that say nothing about the words of a text.
MARKS = np.array([CAPITALS, DIGITS, *(zlib.crc32(b"\x00varied%d" % k) % BUCKETS for k in range(9))])


def _bucket(token: str) -> int:
    """Bucket of a token as written; ``BUCKETS`` more for capitals."""
    if token[0].isdigit() or token[0] == "_":
        return DIGITS
    return zlib.crc32(token.lower().encode()) % BUCKETS + BUCKETS * (len(token) > 2 and token.isupper())


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    found: set[int] = set()
    tokens = TOKEN.findall(text or "")
    distinct = set(tokens)
    if tokens:
        found.add(zlib.crc32(b"\x00varied%d" % (8 * len(distinct) // len(tokens) if len(tokens) >= 16 else 8)) % BUCKETS)
    for token in distinct:
        bucket = _CACHE.get(token)
        if bucket is None:
            bucket = _bucket(token)
            if len(_CACHE) < CACHED_TOKENS:
                _CACHE[token] = bucket
        if bucket >= BUCKETS:
            found.add(CAPITALS)
            bucket -= BUCKETS
        found.add(bucket)
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def training_rows(docs: DataFrame, ratings: DataFrame, grade: Column, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``grade`` and ``found`` (buckets as bytes) of a bounded share of the ratings, as a durable table."""
    rated = ratings.select(F.col(doc_id).alias("__id"), grade.cast("int").alias("__grade")).where("__grade IS NOT NULL AND __id IS NOT NULL")
    n = rated.count()
    if n > sample_rows:
        rated = rated.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))

    def work(batches):
        for batch in batches:
            for part in shares(batch, 1):
                found = [features(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["grade", "found"])

    rows = texts.join(F.broadcast(rated), "__id").select("__grade", "__text")
    return durable(rows.mapInArrow(work, T.StructType().add("grade", "integer").add("found", "binary")))


def _unpacked(batches):
    """By some rows: grades, all buckets one after the other, and where each row begins."""
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            grade, raw = batch.column(0).slice(low, 512), batch.column(1).slice(low, 512).to_pylist()
            sizes = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            yield grade.to_numpy(zero_copy_only=False), np.frombuffer(b"".join(raw), dtype=np.int32), np.cumsum(sizes) - sizes


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[np.concatenate([starts[1:], [len(values)]])] - total[starts] if len(starts) else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Weights of the buckets in use, ordered thresholds, and the tail probability from which documents stay."""

    def __init__(self, grades: list[int], used: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.used, self.thresholds = grades, used, thresholds
        self.dense, self.known = np.zeros(BUCKETS), np.zeros(BUCKETS, dtype=bool)
        self.dense[used] = weights
        self.known[used] = True
        self.known[MARKS] = False
        self.cut = float(self.grade(np.zeros(1))[1][0]) - 1e-9

    def score(self, found: np.ndarray) -> float:
        """Weights of a text's buckets; 0 if none of its words has one."""
        return self.dense[found].sum() if self.known[found].any() else 0.0

    def grade(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the best grade."""
        at_most = _sigmoid(self.thresholds[None, :] - scores[:, None])
        cumulative = np.concatenate([np.zeros((len(scores), 1)), at_most, np.ones((len(scores), 1))], axis=1)
        return np.diff(cumulative, axis=1) @ np.array(self.grades, dtype=float), 1 - at_most[:, -1]


def _loss(rows: DataFrame, place: np.ndarray, scale: np.ndarray, grades: list[int], at: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood and gradient. ``at``: weights, first threshold, logarithms of the gaps to the next."""
    spark, k = rows.sparkSession, len(grades) - 1
    sent = spark.sparkContext.broadcast((place, np.append(scale * at[:-k], 0.0), at))

    def work(batches):
        index, weights, point = sent.value
        n = len(point) - k
        thresholds = point[n] + np.concatenate([[0.0], np.cumsum(np.exp(point[n + 1 :]))])
        loss, count, slope, edges = 0.0, 0, np.zeros(n + 1), np.zeros(k)
        for grade, found, starts in _unpacked(batches):
            where = index[found]
            score = _sums(weights[where], starts)
            level = np.searchsorted(grades, grade)
            upper = np.where(level < k, _sigmoid(np.append(thresholds, 0.0)[level] - score), 1.0)
            lower = np.where(level > 0, _sigmoid(np.append(0.0, thresholds)[level] - score), 0.0)
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            loss -= np.log(p).sum()
            count += len(p)
            lengths = np.diff(np.append(starts, len(found)))
            slope += np.bincount(where, weights=np.repeat(du - dl, lengths), minlength=n + 1)
            edges -= np.bincount(level, weights=du, minlength=k + 1)[:k] - np.bincount(level, weights=dl, minlength=k + 1)[1:]
        whole = np.concatenate([[loss, count], slope[:n], edges])
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["sums"])

    parts = rows.mapInArrow(work, "sums binary").collect()
    sent.destroy()
    total = np.sum([np.frombuffer(r.sums) for r in parts], axis=0)
    loss, count, slope, edges = total[0], total[1], total[2:-k], total[-k:]
    after = np.cumsum(edges[::-1])[::-1]  # a gap moves all later thresholds
    slope = np.concatenate([scale * slope, [after[0]], after[1:] * np.exp(at[len(at) - k + 1 :])]) / count
    held = np.concatenate([at[:-k], np.zeros(k)])
    return loss / count + 0.5 * PENALTY * held @ held, slope + PENALTY * held


def fit(rows: DataFrame, steps: int = STEPS) -> Model | None:
    """Limited-memory quasi-Newton steps over gradients summed in Spark."""
    rows = rows.repartition(max(1, min(64, rows.sparkSession.sparkContext.defaultParallelism)))
    rows = durable(rows)
    counts = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return None
    grades = sorted(counts)

    def tally(batches):
        seen = np.zeros((BUCKETS, len(grades)), dtype=np.int64)
        for grade, found, starts in _unpacked(batches):
            level = np.repeat(np.searchsorted(grades, grade), np.diff(np.append(starts, len(found))))
            np.add.at(seen, (found, level), 1)
        at = np.flatnonzero(seen.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c) for c in seen[at].T]], names=["bucket", *names])

    names = [f"n{k}" for k in range(len(grades))]
    met = rows.mapInArrow(tally, ", ".join(f"{n} bigint" for n in ["bucket", *names]))
    met = met.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).where(sum(map(F.col, names)) >= MIN_ROWS)
    table = np.array(sorted(tuple(r) for r in met.collect()), dtype=np.int64).reshape(-1, 1 + len(grades))
    used, below = table[:, 0], np.cumsum(table[:, 1:], axis=1)
    place = np.full(BUCKETS, len(used), dtype=np.int64)
    place[used] = np.arange(len(used))
    whole = np.cumsum([counts[g] for g in grades])
    with_it = (below[:, :-1] + 1) / (whole[:-1] + 2), (below[:, -1:] - below[:, :-1] + 1) / (whole[-1] - whole[:-1] + 2)
    scale = np.abs(np.log(with_it[0] / with_it[1])).max(axis=1)
    share = np.cumsum([counts[g] for g in grades])[:-1] / sum(counts.values())
    first = np.log(share / (1 - share))
    point = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    loss, slope = _loss(rows, place, scale, grades, point)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        move, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ move) / (s @ y)
            kept.append(a)
            move -= a * y
        move *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.abs(slope).sum())
        for (s, y), a in zip(past, reversed(kept)):
            move += (a - (y @ move) / (s @ y)) * s
        size, fall = 1.0, slope @ move
        for _ in range(12):
            new = point - size * move
            new_loss, new_slope = _loss(rows, place, scale, grades, new)
            if new_loss <= loss - 1e-4 * size * fall:
                break
            size *= 0.4
        else:
            break
        s, y = new - point, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-8:]
        done = loss - new_loss < 1e-5 * abs(loss)
        point, loss, slope = new, new_loss, new_slope
        if done:
            break
    k = len(grades) - 1
    thresholds = point[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(point[len(used) + 1 :]))])
    return Model(grades, used, scale * point[:-k], thresholds)


def fit_with_cut(rows: DataFrame) -> Model | None:
    """The model of four fifths of the rows with the cut of the last; of all rows if the fifth has few of the best ratings."""
    held = F.pmod(F.xxhash64("found"), F.lit(5)) == 0
    best = rows.agg(F.max("grade")).first()[0]
    kept = rows.where(held & (F.col("grade") == best))
    if best is None or kept.count() < MIN_HELD:
        return fit(rows)
    model = fit(rows.where(~held))
    if model is None or model.grades[-1] != best:
        return fit(rows)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            scores = np.array([sent.value.score(np.frombuffer(x, dtype=np.int32)) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.grade(scores)[1])], names=["tail"])

    tails = np.sort([r.tail for r in kept.mapInArrow(work, "tail double").collect()])
    model.cut = min(model.cut, float(tails[int((1 - KEEP_GOOD) * len(tails))]) - 1e-9)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``expected_grade`` and ``tail_probability``, the probability of the best grade; ``prefix`` goes before their names."""
    made = {f"{prefix}expected_grade": T.DoubleType(), f"{prefix}tail_probability": T.DoubleType()}
    schema = with_fields(docs.schema, **made)
    if model is None:
        return docs.select(*[F.col(n) for n in schema.names[:-2]], *[F.lit(None).cast("double").alias(n) for n in made])
    kept, at = schema.names[:-2], docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        own = sent.value
        for batch in batches:
            for part in shares(batch, at):
                scores = np.array([own.score(features(t)) for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*columns_of(part, kept), *map(pa.array, own.grade(scores))], names=schema.names)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(work, schema)


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades of the given labels: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def judge(docs: DataFrame, labels: DataFrame, prefix: str = "") -> DataFrame:
    """Fit on the labels and score all documents; ``kept`` is false for those that are rejected."""
    model = fit_with_cut(training_rows(docs, labels, rating()))
    cut = model.cut if model else 0.0
    return score(docs, model, prefix=prefix).withColumn(f"{prefix}kept", F.coalesce(F.col(f"{prefix}tail_probability") >= cut, F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    return judge(docs, labels, "__").where("__kept").select(docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), labels).select("doc_id", "expected_grade", "tail_probability", "kept")
