"""Whitening against a plain numpy version over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows):
    out = []
    for i, v, *_ in rows:
        if v and all(c is not None and math.isfinite(c) and abs(c) <= whiten.LARGEST for c in v):
            out.append((i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]))
    widths = [len(x) for _, x in out]
    best = max(set(widths), key=lambda w: (widths.count(w), w), default=0)
    return [(i, x) for i, x in out if len(x) == best]


def check(got, rows, components=32):
    kept = usable(rows)
    x = np.array([v for _, v in kept], dtype=object)
    n, sums = len(kept), x.sum(axis=0)
    dev = {}
    for (i, v) in kept:
        dev.setdefault(i, []).append(sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)))
    centred = np.array([[float(c * n - s) / n for c, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(got) == n * m
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((i, d) for i, ds in dev.items() for d in ds)
    for c in range(1, m + 1):
        mine = sorted((r.vec_id, r.whitened) for r in got if r.component == c)
        want = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        signs = [sorted(zip([i for i, _ in kept], (s * want).tolist())) for s in (1, -1)]
        assert any(np.allclose([w for _, w in mine], [w for _, w in s], atol=1e-8) for s in signs), c
        assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-9 for r in got if r.component == c)


def random_rows(n, width, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(width, width)) * np.linspace(1, 3, width)
    return [(k, (rng.normal(size=width) @ mix).astype(np.float32).tolist(), None) for k in range(n)]


@pytest.mark.parametrize("hot", [10_000, 2])
def test_query_equals_plain_version(spark, monkeypatch, hot):
    monkeypatch.setattr(whiten, "HOT_ROWS", hot)
    rows = random_rows(150, 6)
    rows += [(1000 + k, rows[3][1], 1) for k in range(80)] + [(2000 + k, rows[k][1], 2) for k in range(10)]
    rows += [(3000, None, 1), (3001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3002, [math.nan] * 6, 1), (3003, [math.inf] + [0.0] * 5, 1), (3004, [1.0, 2.0], 1)]
    rows += [(3005, [], 1), (3006, [1e30] * 6, 1), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("own") for n in ("x", "copies", "deviation", "whitened", "_h", "n")})
    check(whiten.query(df).collect(), rows)


def test_many_dimensions_and_few_rows(spark):
    rows = random_rows(20, 40, seed=4)
    check(whiten.query(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(c) * 2.0**15 for c in v], None) for k, v, _ in random_rows(40, 3, seed=2)]
    check(whiten.query(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    far = whiten.Fit(10**9, [10**15], np.ones(1), np.ones((1, 1)), 1.0)
    assert far.deviations(np.array([[10**6], [10**8]])) == [0, None]


def test_weights_of_one_fit_the_distinct_vectors(spark):
    rows = random_rows(60, 4)
    copied = rows + [(500 + k, rows[0][1], None) for k in range(100)]
    once, model, error = whiten.whiten(spark.createDataFrame(rows, SCHEMA))
    many, other, other_error = whiten.whiten(spark.createDataFrame(copied, SCHEMA), weights="one")
    assert other.n == 60 and np.allclose(model.values, other.values) and max(error, other_error) < 1e-9
    assert many.count() == 160 and once.count() == 60


def test_tables_without_variance(spark):
    for rows in ([], [(1, None, None)], [(k, [1.0, 2.0], 1) for k in range(5)], [(1, [1.0], None)]):
        got = whiten.query(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
