"""Exact de-duplication of repeated byte strings by a blockwise suffix order with a difference-cover sample.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another.
Texts are UTF-8; strings never cross documents and are judged on the input, overlaps count.

1. Cover sample. The starts whose position modulo v lies in a difference cover are named by the ``length + 1 - v`` bytes
   that follow. For any two equal strings some shift below v leads both to sample starts, with equal names. So the names
   settle which suffixes can tie with another over ``length`` bytes; all others are never sorted.
2. Blocks. The remaining suffixes are sorted one bucket at a time; neighbours that tie over ``length`` bytes are repeats.

Names and ties compare 64-bit fingerprints of the bytes (with the bucket some more bits), and their order is that of the
fingerprints: only ties matter here, not the order of different suffixes. Documents that equal an earlier one as a whole
are covered whole and take no part in step 2.

Null texts count as empty. Repeated rows are documents of their own and so cover each other. Shorter texts stay.
Null ids stay null. Extra columns are not read; join on the id to add them.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import rolling, twins

LENGTH = 400
#: Order of the plane whose lines give the cover: v = q * q + q + 1 residues, q + 1 of them in the sample.
PLANE = 13


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """Perfect difference set modulo q*q + q + 1 for a prime q: exponents of a generator of the cubic field on a plane."""
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):  # x**3 = a x**2 + b x + c
        power, found = (1, 0, 0), []
        for i in range(v):
            if power[2] == 0:
                found.append(i)
            low, middle, high = power
            power = (high * c) % q, (low + high * b) % q, (middle + high * a) % q
        if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
            return v, np.array(found)
    raise ValueError(f"no cover for {q}")


class Chunk:
    """Sample names and candidate suffixes of one chunk; the same every time it is read."""

    def __init__(self, row: dict, length: int, cover: tuple[int, np.ndarray]):
        self.ids, self.texts = twins.unpack(row["body"])
        self.buffer, self.borders = rolling.byte_array(self.texts)
        self.length, (self.v, residues) = length, cover
        self.size = np.diff(self.borders)
        self.values = rolling.BYTE_VALUES[self.buffer]
        sampled = np.zeros(self.v, dtype=bool)
        sampled[residues] = True
        begins = np.repeat(self.borders[:-1], self.size)
        ends = np.repeat(self.borders[1:], self.size)
        at = np.arange(len(self.buffer))
        name = length + 1 - self.v
        self.starts = at[sampled[(at - begins) % self.v] & (at + name <= ends)]
        names = rolling.spans(self.values, self.starts, self.starts + name)
        self.long = np.flatnonzero(self.size >= length)
        whole = rolling.spans(self.values, self.borders[self.long], self.borders[self.long + 1])
        self.prints, self.place, order, first = twins.told(np.concatenate([names, rolling.mix(whole, 1), rolling.mix(whole, 2)]))
        self.many = np.minimum(np.diff(np.append(first, len(order))), 2)

    def judged(self, answers: list[bytes] | None) -> None:
        """Which documents are copies, and the suffixes that may tie."""
        said = twins.read_answers(answers)[self.place]
        n, k = len(self.starts), len(self.long)
        one, two = said[n : n + k], said[n + k :]
        self.copied = np.zeros(len(self.ids), dtype=bool)
        self.copied[self.long[(one > 0) & (two > 0)]] = True
        seen, out = set(), np.zeros(len(self.ids), dtype=bool)
        for doc, place, a, b in zip(self.long, self.place[n : n + k], one, two):
            if a and b:
                out[doc] = max(a, b) == 2 or place in seen
                seen.add(place)
        marks = np.zeros(len(self.buffer) + 1, dtype=np.int32)
        twin = self.starts[said[:n] > 0]
        of = np.searchsorted(self.borders, twin, side="right") - 1
        low = np.maximum(twin - self.v + 1, self.borders[of])
        np.add.at(marks, low, 1)
        np.add.at(marks, twin + 1, -1)
        at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        of = np.searchsorted(self.borders, at, side="right") - 1
        self.suffixes = at[(at + self.length <= self.borders[of + 1]) & ~out[of]]
        found = rolling.spans(self.values, self.suffixes, self.suffixes + self.length)
        self.ties, self.tie_place, order, first = twins.told(found)
        self.tie_many = np.minimum(np.diff(np.append(first, len(order))), 2)

    def covered(self, answers: list[bytes] | None) -> np.ndarray:
        marks = np.zeros(len(self.buffer) + 1, dtype=np.int32)
        tied = self.suffixes[twins.read_answers(answers)[self.tie_place] > 0]
        np.add.at(marks, tied, 1)
        np.add.at(marks, tied + self.length, -1)
        return (np.cumsum(marks[:-1]) > 0) | np.repeat(self.copied, self.size)


def _first_or_later(prints: np.ndarray, more: dict[str, np.ndarray]) -> np.ndarray:
    """0 if met once, 1 for the first chunk that holds a repeated one, 2 for later chunks."""
    order, first, sizes = twins.groups(prints)
    total = twins.together(np.add, more["many"].astype(np.int64), order, first, sizes)
    leads = np.zeros(len(prints), dtype=bool)
    leads[order[first]] = True
    return np.where(total < 2, 0, np.where(leads, 1, 2))


def _tied(prints: np.ndarray, more: dict[str, np.ndarray]) -> np.ndarray:
    order, first, sizes = twins.groups(prints)
    return twins.together(np.add, more["many"].astype(np.int64), order, first, sizes) >= 2


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, plane: int = PLANE) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``span_starts``, ``span_ends`` (maximal removed runs) and ``kept`` (bytes)."""
    cover = difference_cover(plane)
    if cover[0] > length:
        raise ValueError("take a smaller plane: the cover must not be longer than the strings")
    chunks = twins.pack(docs, doc_id, text)

    def name(row):
        chunk = Chunk(row, length, cover)
        return {"prints": chunk.prints, "many": chunk.many}

    def suffixes(row):
        chunk = Chunk(row, length, cover)
        chunk.judged(row["named"])
        return {"prints": chunk.ties, "many": chunk.tie_many}

    def cut(batches):
        for row in twins.rows_of(batches):
            chunk = Chunk(row, length, cover)
            chunk.judged(row["named"])
            gone = chunk.covered(row["tied"])
            out = []
            for doc, (low, high) in enumerate(zip(chunk.borders[:-1], chunk.borders[1:])):
                own = gone[low:high]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                out.append((int(chunk.ids[doc]), int(high - low), int(own.sum()), edges[::2].tolist(), edges[1::2].tolist(), chunk.buffer[low:high][~own].tobytes()))
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "span_starts", "span_ends", "kept"])

    named = twins.with_answers(chunks, twins.round_(chunks, name, _first_or_later, 5, {"many": "u1"}), "named")
    tied = twins.with_answers(named, twins.round_(named, suffixes, _tied, 7, {"many": "u1"}), "tied")
    return tied.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, span_starts array<bigint>, span_ends array<bigint>, kept binary").withColumn("doc_id", twins.given_id())


def query(docs: DataFrame) -> DataFrame:
    rows = remove_repeats(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
