"""Exact substring de-duplication of word sequences with fixed-block anchors.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it has the same words as
one that starts in a document with a smaller id; windows are judged on the input.

1. Anchors. Non-overlapping blocks of half a window are the index, every rolling window of that many words is a probe.
   Two equal windows in different documents each hold a place where a block of the one meets a probe of the other.
2. Extension. From the anchors the windows around them are compared: those whose words also start in a document
   with a smaller id join into maximal repeats.

Words are what stands between white space (space, tab to carriage return), unchanged. Anchors and windows compare 64-bit
fingerprints of the words; anchors only propose. A block in a third of all documents costs one number per chunk.

Null texts have no words. Rows with the same id are one document for the comparison, so they do not remove each other.
Shorter documents stay whole. Null ids come after all
others and count as one document. Extra columns are not read; join on the id to add them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import rolling, twins

WINDOW = 50


class Chunk:
    """Probes and candidate windows of one chunk; the same every time it is read."""

    def __init__(self, row: dict, window: int):
        self.ids, self.texts = twins.unpack(row["body"])
        self.buffer, self.borders = rolling.byte_array(self.texts)
        self.window, self.block = window, window // 2
        self.starts, self.ends, self.first = rolling.words(self.buffer, self.borders)
        self.size = np.diff(self.first)
        self.words = rolling.spans(rolling.BYTE_VALUES[self.buffer], self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.ids)), self.size)
        at = np.arange(len(self.words))
        self.last = self.first[self.doc + 1] if len(at) else at
        self.probes = at[at + self.block <= self.last]
        found = rolling.spans(self.words, self.probes, self.probes + self.block)
        self.prints, self.place, order, firsts = twins.told(found)
        ids = self.ids[self.doc[self.probes]]
        low, high = (twins.fold(how, ids, order, firsts) for how in (np.minimum, np.maximum))
        aligned = (self.probes - self.first[self.doc[self.probes]]) % self.block == 0
        self.flags = 1 + (high > low) + 4 * twins.fold(np.logical_or, aligned, order, firsts)

    def judged(self, answers: list[bytes] | None) -> None:
        """The windows that hold an anchor."""
        anchors = self.probes[twins.read_answers(answers)[self.place] > 0]
        marks = np.zeros(len(self.words) + 1, dtype=np.int32)
        low = np.maximum(anchors - (self.window - self.block), self.first[self.doc[anchors]]) if len(anchors) else anchors
        np.add.at(marks, low, 1)
        np.add.at(marks, anchors + 1, -1)
        at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        self.windows = at[at + self.window <= self.last[at]] if len(at) else at
        found = rolling.spans(self.words, self.windows, self.windows + self.window)
        self.ties, self.tie_place, order, firsts = twins.told(found)
        self.least = twins.fold(np.minimum, self.ids[self.doc[self.windows]], order, firsts)

    def covered(self, answers: list[bytes] | None) -> np.ndarray:
        earlier = twins.read_answers(answers)[self.tie_place] > 0
        own = self.ids[self.doc[self.windows]] > self.least[self.tie_place]
        marks = np.zeros(len(self.words) + 1, dtype=np.int32)
        repeats = self.windows[earlier | own]
        np.add.at(marks, repeats, 1)
        np.add.at(marks, repeats + self.window, -1)
        return np.cumsum(marks[:-1]) > 0


def _anchored(prints: np.ndarray, more: dict[str, np.ndarray]) -> np.ndarray:
    """Met in two documents (chunks hold different documents) and as a block somewhere."""
    order, first, sizes = twins.groups(prints)
    flags = more["flags"].astype(np.int64)
    docs = twins.together(np.add, flags & 3, order, first, sizes)
    return (docs >= 2) & twins.together(np.logical_or, flags > 3, order, first, sizes)


def _earlier(prints: np.ndarray, more: dict[str, np.ndarray]) -> np.ndarray:
    order, first, sizes = twins.groups(prints)
    return twins.together(np.minimum, more["least"], order, first, sizes) < more["least"]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_removed``, ``span_starts``, ``span_ends`` (words) and ``kept``, its other words joined by spaces."""
    chunks = twins.pack(docs, doc_id, text)

    def probe(row):
        chunk = Chunk(row, window)
        return {"prints": chunk.prints, "flags": chunk.flags}

    def extend(row):
        chunk = Chunk(row, window)
        chunk.judged(row["anchors"])
        return {"prints": chunk.ties, "least": chunk.least}

    def cut(batches):
        for row in twins.rows_of(batches):
            chunk = Chunk(row, window)
            chunk.judged(row["anchors"])
            gone = chunk.covered(row["repeats"])
            out = []
            for doc, (low, high) in enumerate(zip(chunk.first[:-1], chunk.first[1:])):
                own, words = gone[low:high], (chunk.texts[doc] or "").encode().split()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                kept = b" ".join([w for w, g in zip(words, own.tolist()) if not g] if len(edges) else words).decode()
                out.append((int(chunk.ids[doc]), len(words), int(own.sum()), edges[::2].tolist(), edges[1::2].tolist(), kept))
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "span_starts", "span_ends", "kept"])

    anchored = twins.with_answers(chunks, twins.round_(chunks, probe, _anchored, 5, {"flags": "u1"}), "anchors")
    repeated = twins.with_answers(anchored, twins.round_(anchored, extend, _earlier, 8, {"least": "<i8"}), "repeats")
    return repeated.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, span_starts array<bigint>, span_ends array<bigint>, kept string").withColumn("doc_id", twins.given_id())


def query(docs: DataFrame) -> DataFrame:
    rows = remove_repeats(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW}),
v AS (SELECT doc_id, s, md5(array_to_string(w[s : s + {WINDOW - 1}], ' ')) AS h FROM spot),
hit AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM v) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM hit),
listed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
