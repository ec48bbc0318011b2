"""Density clustering of wide points against brute force, for whole searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cluster, density, metric


def brute(points, eps, m):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    near = d <= eps
    core = near.sum(axis=1) >= m
    out = np.full(len(points), -1)
    number = 0
    for i in range(len(points)):
        if core[i] and out[i] == -1:
            stack, out[i] = [i], number
            while stack:
                for k in np.flatnonzero(near[stack.pop()] & core & (out == -1)):
                    out[k] = number
                    stack.append(k)
            number += 1
    for i in np.flatnonzero(~core):
        touched = out[near[i] & core]
        out[i] = touched.min() if len(touched) else -1
    return out


def blobs(seed, width=64, n=140):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width)) * 1.5
    points = centres[rng.integers(0, 4, n)] + rng.normal(size=(n, width)) * 0.35
    noise = rng.normal(size=(20, width)) * 3
    chain = centres[0] + np.linspace(0, 1, 25)[:, None] * (centres[1] - centres[0])  # ties two blobs at larger radii
    return np.round(np.concatenate([points, noise, chain, points[:15], points[:1].repeat(30, axis=0)]), 3)


def frame(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, point array<double>")


@pytest.mark.parametrize("block, seed", [(1000, 1), (25, 2)])
def test_all_radii_and_counts_equal_brute_force(spark, monkeypatch, block, seed):
    monkeypatch.setattr(metric, "BLOCK_ROWS", block)
    points = blobs(seed)
    eps, counts = [1.5, 2.6, 3.3, 4.2], [1, 4, 9]
    got = {r.id: r.labels for r in metric.density_labels(frame(spark, points), eps, counts).collect()}
    kinds = set()
    for j, e in enumerate(eps):
        for i, m in enumerate(counts):
            want = brute(points, e, m)
            assert [got[k][j * len(counts) + i] for k in range(len(points))] == want.tolist(), (e, m)
            kinds.add(int(want.max()))
    assert len(kinds) > 3


def test_wide_and_flat_points_take_the_same_answer(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(5)
    flat = np.round(rng.normal(size=(200, 2)) * 3, 2)
    df = frame(spark, flat)
    want = [r.cluster for r in density.dbscan(df, 0.7, 4).orderBy("id").collect()]
    assert [r.cluster for r in metric.dbscan_any(df, 0.7, 4).orderBy("id").collect()] == want
    wide = frame(spark, np.concatenate([flat, np.zeros((200, 6))], axis=1))
    assert [r.cluster for r in density.dbscan(wide, 0.7, 4).orderBy("id").collect()] == want


def test_search_keeps_the_best_silhouette(spark):
    points = blobs(3, width=8)
    df = frame(spark, points)
    best, tried = metric.dbscan_search(df, [0.9, 0.4, 1.6], [3, 6], cluster.silhouette_squared)
    rows = tried.collect()
    assert [(r.eps, r.min_samples) for r in rows] == [(e, m) for e in (0.4, 0.9, 1.6) for m in (3, 6)]
    for r in rows:
        want = brute(points, r.eps, r.min_samples)
        assert (r.n_clusters, r.n_noise) == (want.max() + 1, (want == -1).sum())
        if len(set(want)) > 1:
            labelled = spark.createDataFrame([(p.tolist(), int(c)) for p, c in zip(points, want)], "point array<double>, cluster int")
            assert r.silhouette_squared == pytest.approx(cluster.silhouette_squared(labelled))
    kept = [r for r in rows if r.best]
    assert len(kept) == 1 and kept[0].silhouette_squared == max(r.silhouette_squared for r in rows if r.silhouette_squared is not None)
    assert [r.cluster for r in best.orderBy("id").collect()] == brute(points, kept[0].eps, kept[0].min_samples).tolist()


def test_points_that_are_missing_are_noise(spark):
    rows = [(1, [0.0] * 5), (2, [0.0] * 5), (3, None), (4, [0.0, None, 0.0, 0.0, 0.0]), (5, [float("nan")] * 5), (6, [9.0] * 5)]
    df = spark.createDataFrame(rows, "id long, point array<double>")
    got = {r.id: r.cluster for r in metric.dbscan_any(df, 0.5, 2).collect()}
    assert got == {1: 0, 2: 0, 3: -1, 4: -1, 5: -1, 6: -1}
    assert metric.dbscan_any(df.limit(0), 0.5, 2).count() == 0
    assert {r.cluster for r in metric.dbscan_any(df.where("id = 3"), 0.5, 2).collect()} == {-1}


def test_forest_connects_like_the_whole_graph():
    rng = np.random.default_rng(8)
    for _ in range(20):
        levels = rng.integers(0, 5, size=(12, 9))
        a, b = np.arange(12), rng.permutation(np.arange(6, 15))  # some nodes stand on both sides
        x, y, level = metric.spanning_forest(levels, a, b, 4)
        assert len(x) <= 14
        for top in range(4):
            def parts(edges):
                root = list(range(15))
                for u, v in edges:
                    old, new = root[u], root[v]
                    root = [new if r == old else r for r in root]
                return [tuple(i for i in range(15) if root[i] == root[k]) for k in range(15)]

            every = [(a[i], b[k]) for i, k in zip(*np.nonzero(levels <= top))]
            assert parts(every) == parts([(a[i], b[k]) for i, k, e in zip(x, y, level) if e <= top])


def test_the_parts_of_a_block_share_one_forest():
    import pandas as pd

    rng = np.random.default_rng(8)
    edges = pd.DataFrame({"m": rng.integers(0, 2, 4000), "level": rng.integers(0, 3, 4000), "a": rng.integers(0, 300, 4000), "b": rng.integers(0, 300, 4000)})
    got = metric.thinned(edges)

    def groups(e):
        top = np.arange(300)
        for _ in range(300):
            low = top.copy()
            np.minimum.at(low, e["a"], top[e["b"]])
            np.minimum.at(low, e["b"], top[e["a"]])
            if (low == top).all():
                return top.tolist()
            top = low
        raise AssertionError

    for m in (0, 1):
        assert (got["m"] == m).sum() < 300
        for level in range(3):
            mine = lambda e: e[(e["m"] == m) & (e["level"] <= level)]
            assert groups(mine(got)) == groups(mine(edges))
    assert len(metric.thinned(edges[:0])) == 0


def test_sharp_distances_at_a_radius(spark, monkeypatch):
    monkeypatch.setattr(metric, "ENTRIES", 300)
    points = np.array([[0.1 * i + 1e4, 0.0, 0.0, 0.0, 0.0] for i in range(60)])
    want = brute(points, 0.1, 3)
    got = {r.id: r.cluster for r in metric.dbscan_any(frame(spark, points), 0.1, 3).collect()}
    assert [got[i] for i in range(60)] == want.tolist()


@pytest.mark.parametrize("block, width, first", [(1000, 24, 4), (30, 24, 2), (25, 6, 3)])
def test_close_radii_of_even_points_equal_brute_force(spark, monkeypatch, block, width, first):
    monkeypatch.setattr(metric, "BLOCK_ROWS", block)
    monkeypatch.setattr(metric, "FIRST_BLOCKS", first)
    monkeypatch.setattr(metric, "FEW_MORE", 1)
    monkeypatch.setattr(metric, "ENTRIES", 700)
    rng = np.random.default_rng(9)
    points = rng.normal(size=(420, width))
    points /= np.linalg.norm(points, axis=1)[:, None]
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    eps = [float(np.quantile(gaps, q)) for q in (0.006, 0.008, 0.011, 0.02)]
    got = {r.id: r.labels for r in metric.density_labels(frame(spark, points), eps, [2, 5, 3]).collect()}
    for j, e in enumerate(eps):
        for i, m in enumerate([2, 5, 3]):
            want = brute(points, e, m)
            assert [got[k][j * 3 + i] for k in range(len(points))] == want.tolist(), (e, m)


def test_pairs_within_radii_are_those_of_the_plain_formula():
    from tablewright.operators.blocks import _gaps, within

    rng = np.random.default_rng(4)
    for width, scale, middle in ((2, 1.0, 0.0), (40, 1.0, 0.0), (40, 0.1, 1e4), (40, 1e-9, 0.0), (20, 1e200, 0.0)):
        a, b = (np.round(rng.normal(size=(n, width)), 1) * scale + middle for n in (90, 70))
        if scale > 1e100:
            a[30:] /= scale
            b[20:] /= scale
        i, k = (x.ravel() for x in np.indices((90, 70)))
        with np.errstate(all="ignore"):
            gaps = np.sqrt(_gaps(a, b, i, k))
        edges = sorted({float(x) for x in np.quantile(gaps[np.isfinite(gaps)], (0.01, 0.2, 0.5), method="lower")})  # some pairs lie on an edge
        got = np.full((90, 70), len(edges))
        for low, high, x, y, level in within(a, b, edges, 1000):
            assert len(x) == len({*zip(x.tolist(), y.tolist())}) and ((low <= x) & (x < high)).all()
            got[x, y] = level
        assert (got.ravel() == sum((~(gaps <= e)).astype(int) for e in edges)).all()


def test_dense_points_do_not_meet_everybody(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(6)
    points = np.round(rng.normal(size=(1500, 6)) * 0.2, 6)
    seen, plain = [], metric.Neighbourhoods.meet

    def meet(self, visitors, residents, span, compare, schema):
        copies = self._with(visitors).agg(F.sum(F.size(F.slice("visits", span[0] + 1, span[1] - span[0])))).first()[0]
        seen.append(copies or 0)
        return plain(self, visitors, residents, span, compare, schema)

    monkeypatch.setattr(metric.Neighbourhoods, "meet", meet)
    got = {r.id: r.labels for r in metric.density_labels(frame(spark, points), [0.9, 1.1], [2, 4]).collect()}
    blocks = 1500 / 50
    assert sum(seen) < 0.3 * 3 * 1500 * blocks  # of three steps that compare all blocks
    for c, (e, m) in enumerate([(0.9, 2), (0.9, 4), (1.1, 2), (1.1, 4)]):
        assert [got[k][c] for k in range(1500)] == brute(points, e, m).tolist()
