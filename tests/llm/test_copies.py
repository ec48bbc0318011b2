"""Jaccard join, substring and suffix de-duplication and embeddings against brute force, small limits included."""

import hashlib
import random

import cases
import numpy as np
import pytest

from tablewright.llm import jaccard, neighbours, rolling, substring, suffix, twins
from tablewright.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    return cases.awkward(spark).cache()


@pytest.fixture
def tiny_chunks(monkeypatch):
    monkeypatch.setattr(twins, "CHUNK_BYTES", 3000)


def _key(value):
    return twins.NO_ID if value is None else value


def _given(value):
    return None if value == twins.NO_ID else value


def _sets(rows):
    out = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        out.append((_key(r.doc_id), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


@pytest.mark.parametrize(("frequent", "task"), [(32, 1 << 20), (3, 1 << 20), (3, 400), (1, 60)])
def test_jaccard_equals_brute_force(spark, docs, tiny_chunks, frequent, task):
    sets = _sets(docs.collect())
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    component = cases.components({a for a, _ in sets}, links)
    degree = [sum(bool(x and y and k != j and 100 * len(x & y) >= 80 * len(x | y)) for j, (_, y) in enumerate(sets)) for k, (_, x) in enumerate(sets)]
    got = jaccard.join(cases.with_clashes(docs), frequent=frequent, task_shingles=task).collect()
    expected = [(_given(a), len(x), _given(component[a]), n) for (a, x), n in zip(sets, degree)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_one_of_each_component_stays(spark, docs):
    kept = jaccard.keep_first(cases.with_clashes(docs))
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and kept.columns == cases.with_clashes(docs).columns
    found = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert set(ids) == {a for a, b in found.items() if a is not None and a == b}
    assert sum(r.doc_id is None for r in rows) == 2
    assert jaccard.keep_first(cases.nothing(spark)).count() == 0 and jaccard.query(cases.nothing(spark)).count() == 0


def test_words_of_a_window_with_an_earlier_twin_go(spark, docs, tiny_chunks):
    for window in (50, 6):
        words = [(_key(r.doc_id), (r.text or "").encode().split()) for r in docs.collect()]
        least = {}
        for doc, w in words:
            for k in range(len(w) - window + 1):
                gram = tuple(w[k : k + window])
                least[gram] = min(least.get(gram, doc), doc)
        expected = []
        for doc, w in words:
            gone = set()
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < doc:
                    gone.update(range(k, k + window))
            kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
            expected.append((_given(doc), len(w), len(gone), kept.decode()))
        got = substring.remove_repeats(cases.with_clashes(docs), window=window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted(expected, key=str)
        assert all(sum(b - a for a, b in zip(r.span_starts, r.span_ends)) == r.n_removed for r in got)
    assert substring.query(cases.nothing(spark)).count() == 0


@pytest.mark.parametrize(("length", "plane"), [(70, 5), (31, 3), (35, 5)])
def test_bytes_of_a_repeated_string_go(spark, docs, tiny_chunks, length, plane):
    rng = random.Random(2)
    odd = spark.createDataFrame([(900, "ab" * 300), (901, "x" * 45), (902, "".join(rng.choice("ab") for _ in range(3000))), (903, "é" * 50)], "doc_id long, text string")
    table = docs.where("length(text) < 20000 OR text IS NULL").select("doc_id", "text").unionByName(odd)
    texts = [(r.doc_id, (r.text or "").encode()) for r in table.collect()]
    counts = {}
    for _, x in texts:
        for k in range(len(x) - length + 1):
            counts[x[k : k + length]] = counts.get(x[k : k + length], 0) + 1
    expected = []
    for doc, x in texts:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if counts[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        expected.append((doc, len(x), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    got = suffix.remove_repeats(cases.with_clashes(table), length=length, plane=plane).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffix.query(cases.nothing(spark)).count() == 0


def test_planted_passages_are_read_by_n_removed(spark, tiny_chunks):
    """At the production length: the removal shows in n_removed, n_spans and the digest; n_bytes is the length of the input."""
    rng = random.Random(7)

    def words(n, letters):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters)) for _ in range(n))

    long, short, exact, under = words(60, 7), words(55, 6), words(50, 7) + "x", words(50, 7)
    assert [len(p) for p in (long, short, exact, under)] == [479, 384, 400, 399]
    frames = {k: (f"{words(40 + k, 6)} {chr(65 + k)}", f"{chr(65 + k)} {words(90 - k, 6)}") for k in range(24)}
    planted = {0: long, 7: long, 3: short, 11: short, 5: exact, 13: exact, 9: under, 20: under}
    expected = []
    for k, (before, after) in frames.items():
        gone = planted.get(k, "")
        lost = len(gone) if len(gone) >= 400 else 0
        kept = before + (gone if not lost else "") + after
        expected.append((k, len(before + gone + after), lost, int(lost > 0), hashlib.sha256(kept.encode()).hexdigest()))
    table = spark.createDataFrame([(k, a + planted.get(k, "") + b) for k, (a, b) in frames.items()], "doc_id long, text string")
    got = suffix.query(table).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
    assert {r.doc_id for r in got if r.n_removed} == {0, 7, 5, 13}


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_cover_meets_every_difference(q):
    v, found = suffix.difference_cover(q)
    assert len(found) == q + 1 and {(a - b) % v for a in found for b in found} == set(range(v))


def test_long_spans_and_windows_have_stable_fingerprints(monkeypatch):
    values = rolling.BYTE_VALUES[np.frombuffer(b"abc" * 1000, dtype=np.uint8)]
    whole = rolling.windows(values, 50)
    assert len(set(whole.tolist())) == 3
    pieces = np.concatenate([rolling.windows(values[k : k + 50], 50) for k in range(0, 2000, 7)])
    assert np.array_equal(pieces, whole[0:2000:7])
    starts = np.array([0, 3, 1])
    long = rolling.BYTE_VALUES[np.zeros(rolling.SHARE * 2 + 5, dtype=np.uint8)]
    a = rolling.spans(long, np.array([0, 4]), np.array([rolling.SHARE + 9, rolling.SHARE + 13]))
    assert a[0] == a[1] and starts.size == 3


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = cases.components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in expected.items() if k in got} and set(expected) - set(got) <= {5, *[a for a, b in edges if a == b]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, ident = [], 0
    for label in (1, 2, 3):
        base = rng.standard_normal((150, 16))
        near = base[:8].repeat(6, axis=0) + 0.02 * rng.standard_normal((48, 16))
        cloud = base[9] + 0.08 * rng.standard_normal((120, 16))
        for x in [*base, *near, *cloud, *base[:4], 3 * base[5], -base[6]]:
            rows.append((ident, [float(np.float32(v)) for v in x], label))
            ident += 1
    some = rows[0][1]
    rows += [(ident, None, 1), (ident + 1, [0.0] * 16, 1), (ident + 2, [None, *some[1:]], 1), (ident + 3, [float("nan"), *some[1:]], 1), (ident + 4, some, None),
             (ident + 5, some[:8], 1), (ident + 6, [float("inf"), *some[1:]], 2), (ident + 7, [], 1), (None, some, 1), (ident + 8, some[:8], 2), rows[3]]
    return rows


@pytest.mark.parametrize("task_rows", [4096, 40])
def test_embeddings_equal_brute_force(spark, task_rows, monkeypatch):
    monkeypatch.setattr(neighbours.links, "__defaults__", (task_rows,))
    rows = _vectors()
    ids = [_key(r[0]) for r in rows]
    good = [bool(r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])) for r in rows]
    units = [np.array(r[1]) / np.linalg.norm(r[1]) if g else None for r, g in zip(rows, good)]
    linked = [[bool(good[a] and good[b]) and a != b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98 for b in range(len(rows))] for a in range(len(rows))]
    component = cases.components(set(ids), [(ids[a], ids[b]) for a in range(len(rows)) for b in range(a) if linked[a][b]])
    expected = [(_given(i), sum(linked[k]), _given(component[i]), component[i] == i) for k, i in enumerate(ids)]
    table = cases.with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = neighbours.near_duplicates(table).cache()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert neighbours.audit(table, found, every=5) >= 0.99
    if task_rows == 4096:
        assert neighbours.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("task_rows", [4096, 80])
def test_dense_groups_just_over_the_threshold_are_linked(spark, task_rows, monkeypatch):
    monkeypatch.setattr(neighbours.links, "__defaults__", (task_rows,))
    monkeypatch.setattr(neighbours.reaching, "__defaults__", (task_rows,))
    rng, axes, n = np.random.default_rng(2), np.linalg.qr(np.random.default_rng(1).normal(size=(64, 64)))[0], 300
    angle = np.arccos(0.9865)
    # the third group is 30 degrees from both
    centres = [axes[0], np.cos(angle) * axes[0] + np.sin(angle) * axes[1], np.cos(np.pi / 6) * axes[0] + 0.5 * axes[2]]
    x = np.repeat(centres, n, axis=0) + rng.normal(size=(3 * n, 64)) * np.sqrt(0.001 / 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    assert near[:n, n : 2 * n].all() and not near[: 2 * n, 2 * n :].any()
    table = spark.createDataFrame([(k, x[k].tolist(), 1) for k in range(len(x))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(table).collect()}
    assert got == {k: (int(near[k].sum()) - 1, 0 if k < 2 * n else 2 * n) for k in range(len(x))}
