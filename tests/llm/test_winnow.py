"""Winnowing against a plain version, its guarantee, and the query against brute force."""

import hashlib
import random

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import winnow


def plain(text, k, w):
    """Chosen (hash, position) of a text, window by window."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = max(1, len(text) - k + 1)
    size = min(k, len(text))
    own = [int(winnow.hashes(codes[i : i + size], np.array([0]), np.array([size]))[0]) >> 16 for i in range(n)]
    out = set()
    for low in range(max(1, n - w + 1)):
        window = own[low : low + w]
        best = min(window)
        out.add(low + max(i for i, h in enumerate(window) if h == best))
    return [(own[i], i) for i in sorted(out)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.none() | st.text("ab 😀", max_size=60), max_size=6), k=st.integers(1, 5), w=st.integers(1, 9), segment=st.sampled_from([1, 3, 1 << 15]))
def test_chosen_hashes_equal_the_plain_version(texts, k, w, segment):
    before, winnow.SEGMENT = winnow.SEGMENT, segment
    try:
        values, place, counts = winnow.winnow(texts, k, w, most=50)
    finally:
        winnow.SEGMENT = before
    cuts = np.cumsum(counts)
    got = [list(zip(values[e - n : e].tolist(), place[e - n : e].tolist())) for n, e in zip(counts, cuts)]
    assert got == [plain(t, k, w) for t in texts]


def test_a_shared_passage_shares_a_hash():
    rng = random.Random(5)
    letters = "abcdefgh "
    for _ in range(30):
        passage = "".join(rng.choices(letters, k=winnow.K + winnow.W - 1))
        texts = ["".join(rng.choices(letters, k=rng.randrange(400))) + passage + "".join(rng.choices(letters, k=rng.randrange(400))) for _ in range(2)]
        values, _, counts = winnow.winnow(texts)
        assert set(values[: counts[0]]) & set(values[counts[0] :])


def said(text):
    return ",".join(f"{h:x}:{p}" for h, p in plain(text, winnow.K, winnow.W))


def like(a, b):
    x, y = ({h for h, _ in plain(t, winnow.K, winnow.W)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("partitions", [2, 40])
def test_query_equals_brute_force(spark, partitions):
    docs = cases.with_clashes(cases.awkward(spark, copies=10)).where("doc_id is null or doc_id not in (305)")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = winnow.query(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hashed = docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    rows = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)]
    expected = []
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((i, len(text), digest, said(text), said(edited), round(like(text, edited), 12), round(like(text, after), 12)))
    assert sorted([(*r[:5], round(r[5], 12), round(r[6], 12)) for r in got], key=str) == sorted(expected, key=str)


def test_single_documents_and_empty_tables(spark):
    assert winnow.query(cases.nothing(spark)).count() == 0
    assert winnow.fingerprints(cases.nothing(spark)).count() == 0
    docs = spark.createDataFrame([(None, "alone here", None, None, None)], cases.DOCS)
    (row,) = winnow.query(docs).collect()
    assert (row.n_chars, row.near_edited <= 1, row.near_next) == (10, True, 1.0)
    marked = winnow.fingerprints(cases.with_clashes(docs).withColumn("hashes", docs.lang)).first()
    assert len(marked.hashes) == 1 and marked.positions == [0] and marked.kept == "own kept"


def test_long_texts_equal_the_plain_version():
    rng = random.Random(6)
    text = "".join(rng.choices("abc", k=3 * winnow.SEGMENT + 77))
    values, place, counts = winnow.winnow(["short", text, None])
    found = plain(text, winnow.K, winnow.W)
    assert list(zip(values.tolist(), place.tolist()))[1:] == found and counts.tolist() == [1, len(found), 0]
