"""Cross-tokenizer alignment against a brute-force version that tokenizes whole texts."""

import hashlib
from collections import Counter, defaultdict

import cases
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import align
from tablewright.llm.bpe import byte_characters
from tablewright.plans.durable import durable

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def groups_of(tokenizers, text):
    """Groups of one text as lists of A and B ids; None where bytes differ."""
    a, b = tokenizers
    if not text:
        return None
    byte_of = {c: x for x, c in byte_characters().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    out, i, k, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(ids_a) or k < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            out[-1][0].append(ids_a[i])
            end_a += len(raw_a[i])
            i += 1
        else:
            out[-1][1].append(ids_b[k])
            end_b += len(raw_b[k])
            k += 1
        if end_a == end_b:
            out.append(([], []))
    return out[:-1]


def brute(tokenizers, rows):
    groups = [groups_of(tokenizers, t) for _, t in rows]
    links = [Counter((x, y) for ga, gb in g or [] for x in ga for y in gb) for g in groups]
    counts = Counter(p for own in links for p in own)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, _), g, own in zip(rows, groups, links):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g or [])
        best = sum(n for p, n in own.items() if counts[p] == highest[p[0]])
        out.append((doc, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(own.values()), best,
                    sum(n * counts[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


ODD = [" ", "  lead", "tail  ", "a  b\n c", "▁mark", "\x00z", "日本語 テキスト", "ﬁ é é", "<|endoftext|> <s></s> <0x41>", "\x1c \x85 x", "😀👩‍👩‍👧 a", " " * 700, "=" * 900]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list("ab'sé ñ\n\t 12²_-▁!\x1c\x85日😀")) | st.characters(exclude_categories=["Cs"]), min_size=1, max_size=40), max_size=4))
def test_pieces_give_the_groups_of_whole_texts(tokenizers, texts):
    own = align.aligner(JSON, MODEL)
    stats, said, _, _, _ = own.measure([" " + t for t in texts])
    for t, row, line in zip(texts, stats.tolist(), said):
        g = groups_of(tokenizers, t)
        assert line == (None if g is None else ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)), repr(t)
        assert row[2] == len(g or []) and row[3] == sum(len(x) * len(y) for x, y in g or [])


@pytest.mark.parametrize("frequent, part, slice_, kept", [(500_000, 1 << 20, 1 << 16, 250_000), (300, 200, 1, 50)])
def test_query_equals_brute_force(spark, tokenizers, monkeypatch, frequent, part, slice_, kept):
    docs = cases.awkward(spark).unionByName(spark.createDataFrame([(900 + k, t, "en", "s", 1) for k, t in enumerate(ODD)], cases.DOCS))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, value in (("FREQUENT", frequent), ("PART", part), ("SLICE", slice_), ("KEPT_PIECES", kept)):
        monkeypatch.setattr(align, name, value)
    if part == 200:
        own = align.Aligner(JSON, MODEL)
        text = " " + " ".join(t for _, t in rows if t and "▁" not in t)
        whole = groups_of(tokenizers, text[1:])
        stats, digest, _, times = align._long(own, text)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in whole)
        assert stats[2] == len(whole) and digest == hashlib.sha256(said.encode()).hexdigest() and times.sum() == stats[3]
    got = align.query(cases.with_clashes(docs), JSON, MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == brute(tokenizers, rows)


def test_counts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (2, "one"), (3, None)], "doc_id long, text string")
    aligned = durable(align.align(docs, JSON, MODEL))
    counts = {r.pair: r.n for r in align.pair_counts(aligned).collect()}
    assert sorted(counts.values()) == [2, 3]
    assert align.query(cases.nothing(spark), JSON, MODEL).count() == 0
    assert align.pair_counts(aligned).where(F.col("best")).count() == 2
