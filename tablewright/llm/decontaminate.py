"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is ``window`` consecutive
words of one item; an item with fewer words, but not none, is one window. The automaton of all items reads the training
words one by one and knows at each word the longest match that ends there, from which the words inside windows and the
items that hold them follow. Spans of such words are removed; a text with a larger share of them than
``max_coverage`` is dropped whole.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text (one larger item is a block of its own), so what is
broadcast is bounded; the training table is read once for all blocks, which follow one another in the same task.

Null texts have no words; null items and items without words have no windows; windows of items with a null id are
removed too, but such items are neither counted nor named. Items with the same id count once. Repeated documents are
judged row by row. Extra columns pass through; columns called like the result columns are replaced.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.arrow import columns_of, shares, with_fields

WINDOW, MAX_COVERAGE, BLOCK_BYTES = 10, 0.5, 8 << 20

#: Upper to lower case, and everything that is no part of a word to a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window, self.word_ids = window, {}
        texts = [(name, [self.word_ids.setdefault(w, len(self.word_ids)) for w in words(text)]) for name, text in items]
        texts = [(name, ids) for name, ids in texts if ids]
        self.width = max(1, len(self.word_ids))
        self.step: dict[int, int] = {}
        self.link, self.longest = [-1], [0]
        edges: list[dict[int, int]] = [{}]
        for _, ids in texts:
            last = 0
            for word in ids:
                last = self._extend(edges, last, word)
        self.step = {state * self.width + word: to for state, out in enumerate(edges) for word, to in out.items()}
        self.shortest = min([window, *(len(ids) for _, ids in texts)], default=window)
        self._name(texts)

    def _extend(self, edges: list[dict[int, int]], last: int, word: int) -> int:
        link, longest = self.link, self.longest
        if (to := edges[last].get(word)) is not None:
            if longest[to] == longest[last] + 1:
                return to
            return self._split(edges, last, word, to)
        new = len(edges)
        edges.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in edges[at]:
            edges[at][word] = new
            at = link[at]
        if at >= 0:
            to = edges[at][word]
            link[new] = to if longest[to] == longest[at] + 1 else self._split(edges, at, word, to)
        return new

    def _split(self, edges: list[dict[int, int]], at: int, word: int, to: int) -> int:
        """A state of its own for the shorter sequences of ``to``."""
        twin = len(edges)
        edges.append(dict(edges[to]))
        self.longest.append(self.longest[at] + 1)
        self.link.append(self.link[to])
        self.link[to] = twin
        while at >= 0 and edges[at].get(word) == to:
            edges[at][word] = twin
            at = self.link[at]
        return twin

    def _name(self, texts: list[tuple[str | None, list[int]]]) -> None:
        """Which items hold the window that ends in a state, and which whole items end in it."""
        order = sorted(range(len(self.link)), key=self.longest.__getitem__)
        self.anchor = [0] * len(self.link)  # the state of the last ``window`` words
        for state in order:
            parent = self.link[state]
            if self.longest[state] >= self.window:
                self.anchor[state] = state if parent < 0 or self.longest[parent] < self.window else self.anchor[parent]
        self.items: dict[int, set[str]] = {}
        whole: dict[int, set[tuple[int, str | None]]] = {}
        for name, ids in texts:
            state = 0
            for at, word in enumerate(ids):
                state = self.step[state * self.width + word]
                if at + 1 >= self.window:
                    self.items.setdefault(self.anchor[state], set()).update([name] if name is not None else [])
            if len(ids) < self.window:
                whole.setdefault(state, set()).add((len(ids), name))
        # short items that end in a state, its suffixes included, and the length from which anything is found
        self.whole: list[tuple] = [()] * len(self.link)
        self.alert = [1 << 60] * len(self.link)
        for state in order:
            above = self.whole[self.link[state]] if state else ()
            self.whole[state] = (*above, *sorted(whole.get(state, ()), key=str))
            lengths = [n for n, _ in self.whole[state]] + [self.window] * (self.longest[state] >= self.window)
            self.alert[state] = min(lengths, default=1 << 60)

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Marks of the words inside windows, and the items that hold these."""
        marks, names = np.zeros(len(ids) + 1, dtype=np.int32), set()
        known = np.concatenate([[False], ids >= 0, [False]])
        borders = np.flatnonzero(known[1:] != known[:-1])
        step, link, longest, alert, width, window = self.step.get, self.link, self.longest, self.alert, self.width, self.window
        for low, high in zip(borders[::2].tolist(), borders[1::2].tolist()):
            if high - low < self.shortest:
                continue
            state = length = 0
            for at, word in enumerate(ids[low:high].tolist(), low):
                while (to := step(state * width + word)) is None and state:
                    state = link[state]
                    length = longest[state]
                if to is None:
                    continue
                state, length = to, length + 1
                if length >= alert[state]:
                    if length >= window:
                        marks[at - length + 1] += 1
                        marks[at + 1] -= 1
                        names |= self.items[self.anchor[state]]
                    for n, name in self.whole[state]:
                        if length >= n:
                            marks[at - n + 1] += 1
                            marks[at + 1] -= 1
                            if name is not None:
                                names.add(name)
        return np.cumsum(marks[:-1]) > 0, names


def blocks(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list:
    """Broadcast automata, each of a bounded share of the items."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    part = F.pmod(F.xxhash64("name", "text"), F.lit(parts))
    return [
        spark.sparkContext.broadcast(Automaton([(r.name_, r.text) for r in rows.where(part == k).withColumnRenamed("name", "name_").collect()], window))
        for k in range(parts)
    ]


def mark(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_bytes: int = BLOCK_BYTES, cut: bool = False, prefix: str = "",
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings) and ``dropped``; with ``cut``, remove the spans from the text.

    ``prefix`` goes before the added names.
    A removed span reaches from its first to its last word; what stands between words of one span goes too.
    """
    automata = blocks(items, item_id, item_text, window, block_bytes)
    made = {"n_words": T.LongType(), "n_hit": T.LongType(), "item_ids": T.ArrayType(T.StringType()), "dropped": T.BooleanType()}
    made = {prefix + name: kind for name, kind in made.items()}
    kept, at = [f.name for f in docs.schema.fields if f.name not in made], docs.columns.index(text)
    schema = with_fields(docs.schema, **made)

    def one(value: str | None):
        tokens, marks, names = words(value), None, set()
        for automaton in automata:
            get = automaton.value.word_ids.get
            ids = np.fromiter(map(get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
            own, found = automaton.value.scan(ids)
            marks, names = own if marks is None else marks | own, names | found
        n_hit = int(marks.sum())
        dropped = n_hit > max_coverage * len(tokens)
        if cut and n_hit and not dropped:
            value = without(value, marks)
        return value, len(tokens), n_hit, sorted(names), dropped

    def work(batches):
        for batch in batches:
            for part in shares(batch, at):
                rows = [one(v) for v in part.column(at).to_pylist()]
                new, n_words, n_hit, names, dropped = zip(*rows)
                out = [pa.array(new, type=c.type) if n == text and cut else c for n, c in zip(kept, columns_of(part, kept))]
                out += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(dropped, pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.mapInArrow(work, schema)


def without(text: str, marks: np.ndarray) -> str:
    """The text without its marked words."""
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    out, last = [], 0
    for low, high in zip(edges[::2], edges[1::2]):
        out.append(raw[last : spans[low][0]])
        last = spans[high - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def remove(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without their contaminated spans, and without those that are mostly contaminated."""
    return mark(docs, items, cut=True, prefix="__", **options).where("NOT __dropped").select(docs.columns)


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = mark(docs.select("doc_id", "text"), items)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') AS v
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
found AS (
    SELECT doc_id, s, n, item FROM (
        SELECT doc_id, n AS size, s, array_to_string(w[s : s + n - 1], ' ') AS v
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) p
    JOIN windows ON p.size = windows.n AND p.v = windows.v),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
