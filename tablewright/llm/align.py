"""Alignment of two tokenizers' tokens on the bytes that they cover (cross-tokenizer alignment).

A is a byte-level BPE of the tokenizers library, read from JSON and applied to a space and the text; B is a sentencepiece
model, which adds that space itself. Both give the bytes space + text in tokens, so the places where tokens of both end cut
the two id lists into groups. These places are the intersection of the hash sets of cumulative ends, looked up in
dictionaries from end to index; the sorted common ends slice both lists, and the links are the pairs within a slice.

Neither tokenizer has a token that reaches over the border between a character other than white space and a space (the
vocabulary of B is checked for it; else texts go whole), so a text is cut there and the groups of a piece are remembered by
the task: they are the same wherever the piece comes. Ids of pairs are counted over all documents; the at most ``FREQUENT``
commonest pairs are broadcast, the others are joined by a shuffle, where none of them can be hot.

Null and empty texts, and texts that B normalises or that hold its space mark, have no tokens: zeros and an empty digest.
Very long texts are worked on in parts of about ``PART`` characters; a part without a border stays whole. Every row counts
as a document of its own, repeated rows and null or repeated ids included; ties for the highest count all count as highest.
Only ``doc_id`` and the text column are read, so names of extra columns cannot clash. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.arrow import lists, shares
from tablewright.llm.bpe import byte_characters, gather
from tablewright.plans.durable import durable

#: Pieces that a task remembers between shares, and the links of them.
KEPT_PIECES, KEPT_LINKS = 250_000, 1 << 21
#: Pieces that stay for the next task of the same process.
KEPT_AFTER = 50_000
#: Characters of a long text that are worked on at once.
PART = 1 << 20
#: Pairs of ids in the broadcast at most, 17 bytes each.
FREQUENT = 500_000
#: Links of one slice that are written out one by one; larger slices count equal ids first.
SLICE = 1 << 16
#: Place of the A id in a pair.
SHIFT = 20

ALIGNED = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType())]
    + [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]
)


class Vocabulary:
    """The bytes of every id."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.starts[ids], self.sizes[ids]).tobytes()


def common_slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends that both lists share, in order, and how many tokens of each list lie up to them."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    numbers = [np.fromiter(map(at.__getitem__, common), dtype=np.int64, count=len(common)) for at in (at_a, at_b)]
    return np.array(common, dtype=np.int64), *numbers


def linked(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids of every slice, how often each is linked there, and the number of entries of each slice."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    from_a, from_b = cut_a - n_a, cut_b - n_b
    wide = n_a * n_b > SLICE
    counts = np.where(wide, 0, n_a * n_b)
    of_token = np.repeat(np.arange(len(n_a)), np.where(wide, 0, n_a))
    tokens = ids_a[np.repeat(~wide, n_a)].astype(np.int64)
    partners = n_b[of_token]
    pairs = (np.repeat(tokens, partners) << SHIFT) | gather(ids_b, from_b[of_token], partners)
    times = np.ones(len(pairs), dtype=np.int64)
    for g in np.flatnonzero(wide)[::-1]:
        a, many_a = np.unique(ids_a[from_a[g] : cut_a[g]], return_counts=True)
        b, many_b = np.unique(ids_b[from_b[g] : cut_b[g]], return_counts=True)
        at = int(counts[:g].sum())
        own = ((a.astype(np.int64)[:, None] << SHIFT) | b).ravel()
        pairs = np.concatenate([pairs[:at], own, pairs[at:]])
        times = np.concatenate([times[:at], (many_a[:, None] * many_b).ravel(), times[at:]])
        counts[g] = len(own)
    return pairs, times, counts


class Aligner:
    """Both tokenizers, with the pieces that have been aligned."""

    def __init__(self, json_path: str, model_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        byte_of = {c: b for b, c in byte_characters().items()}
        spelt = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            spelt[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.of_a = Vocabulary(spelt)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.of_b = Vocabulary(raw)
        self.space = self.b.piece_to_id("▁")
        reaching = any("▁" in p.lstrip("▁") for p in pieces)
        self.border = None if reaching else re.compile(r"(?<=\S) ")
        self.blanks = re.compile(r"\s ")
        self.clear()

    def clear(self) -> None:
        """Drop the remembered pieces."""
        self.known: dict[str, int] = {}
        self.said: list[str | None] = []
        self.stats = np.zeros((1 << 12, 5), dtype=np.int64)  # tokens of A, of B, groups, links, entries of pairs
        self.at = np.zeros(1 << 12, dtype=np.int64)
        self.pairs, self.times, self.used = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0

    def _shorten(self, most: int) -> None:
        """Keep the first pieces that came: they are the common ones."""
        if len(self.known) > most:
            self.known = dict(islice(self.known.items(), most))
            self.said = self.said[:most]
            self.used = int(self.at[most - 1] + self.stats[most - 1, 4])

    def forget(self) -> None:
        """Drop all but the common pieces, whose memory the next work of the same process may need."""
        self._shorten(KEPT_AFTER)
        n, more = len(self.known), 1 << 12
        self.stats = np.concatenate([self.stats[:n], np.zeros((more, 5), dtype=np.int64)])
        self.at = np.concatenate([self.at[:n], np.zeros(more, dtype=np.int64)])
        self.pairs, self.times = (np.concatenate([x[: self.used], np.zeros(1 << 16, dtype=np.int64)]) for x in (self.pairs, self.times))

    def cut(self, text: str) -> list[str]:
        """The text at its borders."""
        if self.border is None:
            return [text]
        if not self.blanks.search(text):  # every space but the first is a border
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        places = [m.start() for m in self.border.finditer(text)]
        return [text[i:j] for i, j in zip([0, *places], [*places, len(text)])]

    def parts(self, text: str) -> list[str]:
        """A long text in parts that end at borders."""
        out, low = [], 0
        while self.border is not None and (found := self.border.search(text, low + PART)):
            out.append(text[low : found.start()])
            low = found.start()
        return [*out, text[low:]]

    def _align(self, pieces: list[str]) -> bool:
        """Align pieces that follow each other in one text; False if a tokenizer changes bytes or reaches over a border."""
        text = "".join(pieces)
        raw = text.encode()
        (encoded,) = self.a.encode_batch_fast([text], add_special_tokens=False)
        ids_a = np.array(encoded.ids, dtype=np.int64)
        ids_b = np.array(self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space], dtype=np.int64)
        if self.of_a.spell(ids_a) != raw or self.of_b.spell(ids_b) != raw:
            return False
        borders = np.cumsum([len(p.encode()) for p in pieces])
        ends, cut_a, cut_b = common_slices(np.cumsum(self.of_a.sizes[ids_a]), np.cumsum(self.of_b.sizes[ids_b]))
        last = np.searchsorted(ends, borders)
        if not len(ends) or (ends[np.minimum(last, len(ends) - 1)] != borders).any():
            return False
        pairs, times, counts = linked(ids_a, ids_b, cut_a, cut_b)
        n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        words_a, words_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        low_a, low_b = (cut_a - n_a).tolist(), (cut_b - n_b).tolist()
        said = [
            f"{words_a[i]}|{words_b[k]}" if j == i + 1 and m == k + 1 else f"{','.join(words_a[i:j])}|{','.join(words_b[k:m])}"
            for i, j, k, m in zip(low_a, cut_a.tolist(), low_b, cut_b.tolist())
        ]
        groups = last + 1
        sums = np.stack([cut_a[last], cut_b[last], groups, np.cumsum(n_a * n_b)[last], np.cumsum(counts)[last]], axis=1)
        first = np.concatenate([[0], groups[:-1]]).tolist()
        self._keep(pieces, np.diff(sums, axis=0, prepend=0), [";".join(said[i:j]) for i, j in zip(first, groups.tolist())], pairs, times)
        return True

    def _keep(self, pieces: list[str], stats: np.ndarray, said: list, pairs: np.ndarray, times: np.ndarray) -> None:
        n, more = len(self.known), len(pieces)
        while n + more > len(self.at):
            self.at, self.stats = np.concatenate([self.at, self.at * 0]), np.concatenate([self.stats, self.stats * 0])
        while self.used + len(pairs) > len(self.pairs):
            self.pairs, self.times = np.concatenate([self.pairs, self.pairs * 0]), np.concatenate([self.times, self.times * 0])
        self.pairs[self.used : self.used + len(pairs)] = pairs
        self.times[self.used : self.used + len(pairs)] = times
        self.stats[n : n + more] = stats
        self.at[n : n + more] = self.used + np.cumsum(stats[:, 4]) - stats[:, 4]
        self.known.update(zip(pieces, range(n, n + more)))
        self.said += said
        self.used += len(pairs)

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if p[0] == " " and not p[-1].isspace()]
        alone = [p for p in pieces if p[0] != " " or p[-1].isspace()]
        for low in range(0, len(plain), 4096):
            some = plain[low : low + 4096]
            if not self._align(some):
                alone += some
        for p in alone:
            if not self._align([p]):
                self._keep([p], np.zeros((1, 5), dtype=np.int64), [None], self.pairs[:0], self.times[:0])

    def measure(self, texts: list[str]) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that begin with a space: numbers of tokens, groups and links, the groups as text (None where bytes
        differ), then text number, pair and times, ordered, of every pair of ids in a text."""
        self._shorten(KEPT_PIECES)
        if self.used > KEPT_LINKS:
            self.clear()
        cuts = [self.cut(t) for t in texts]
        flat = [p for c in cuts for p in c]
        self._learn([p for p in dict.fromkeys(flat) if p not in self.known])
        which = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        ends = np.cumsum([len(c) for c in cuts])
        of_text = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        said: list[str | None] = []
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own = list(map(self.said.__getitem__, which[low:high].tolist()))
            said.append(None if None in own else ";".join(own))  # type: ignore[arg-type]
        good = np.array([s is not None for s in said], dtype=bool)
        stats = np.add.reduceat(self.stats[which, :4], np.concatenate([[0], ends[:-1]]), axis=0) * good[:, None] if len(flat) else np.zeros((0, 4), dtype=np.int64)
        which, of_text = which[good[of_text]], of_text[good[of_text]]
        sizes = self.stats[which, 4]
        entries = (np.repeat(of_text, sizes) << 40) | gather(self.pairs, self.at[which], sizes)
        own, inverse = np.unique(entries, return_inverse=True)
        times = np.zeros(len(own), dtype=np.int64)
        np.add.at(times, inverse, gather(self.times, self.at[which], sizes))
        return stats, said, own >> 40, own & ((1 << 40) - 1), times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(json_path: str, model_path: str) -> Aligner:
    if (json_path, model_path) not in _ALIGNERS:
        _ALIGNERS[json_path, model_path] = Aligner(json_path, model_path)
    return _ALIGNERS[json_path, model_path]


def _long(own: Aligner, text: str) -> tuple[np.ndarray, str | None, np.ndarray, np.ndarray]:
    """One long text part by part: numbers, digest, pairs, times."""
    stats, digest, found, parts = np.zeros(4, dtype=np.int64), hashlib.sha256(), [], own.parts(text)
    for k, part in enumerate(parts):
        some, said, _, pairs, times = own.measure([part])
        if said[0] is None:
            return np.zeros(4, dtype=np.int64), None, pairs[:0], times[:0]
        stats += some[0]
        digest.update((";" * (k > 0) + said[0]).encode())
        found.append((pairs, times))
        if len(found) == 16 or k == len(parts) - 1:
            keys, inverse = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, inverse, np.concatenate([t for _, t in found]))
            found = [(keys, sums)]
    return stats, digest.hexdigest(), *found[0]


def align(df: DataFrame, json_path: str, model_path: str, text: str = "text") -> DataFrame:
    """Per row: a row number, numbers of tokens, groups and links, SHA-256 of the groups, and its pairs of ids
    (A id << 20 | B id) with how often each is linked."""

    def work(batches):
        own = aligner(json_path, model_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in shares(batch, 1):
                texts = [" " + t if t else "" for t in part.column(1).to_pylist()]
                n = len(texts)
                stats, digests = np.zeros((n, 4), dtype=np.int64), [""] * n
                usual = [i for i, t in enumerate(texts) if t and len(t) <= 2 * PART]
                some, said, of_text, pairs, times = own.measure([texts[i] for i in usual])
                sizes = np.zeros(n, dtype=np.int64)
                if usual:
                    stats[usual] = some
                    sizes[usual] = np.bincount(of_text, minlength=len(usual))
                    for i, s in zip(usual, said):
                        digests[i] = hashlib.sha256(s.encode()).hexdigest() if s is not None else ""
                for i, t in enumerate(texts):
                    if len(t) > 2 * PART:
                        stats[i], digest, more, more_times = _long(own, t)
                        digests[i] = digest or ""
                        at = int(sizes[:i].sum())
                        pairs, times = np.insert(pairs, at, more), np.insert(times, at, more_times)
                        sizes[i] = len(more)
                made = [pa.array(np.arange(row, row + n)), part.column(0), *[pa.array(stats[:, k]) for k in range(4)], pa.array(digests, type=pa.string())]
                row += n
                yield pa.RecordBatch.from_arrays([*made, lists(pairs, sizes, pa.int64()), lists(times, sizes, pa.int64())], names=ALIGNED.names)
        own.forget()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Number of documents of every linked pair of ids, and whether it is the highest of its A id."""
    counts = durable(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", SHIFT).alias("a")
    highest = counts.groupBy(a).agg(F.max("n").alias("highest"))  # one row per id of A's vocabulary at most
    joined = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    return joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _frequent(counts: DataFrame) -> int:
    """The least power of two of a count such that at most ``FREQUENT`` pairs have it."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("b")).count().collect()  # 63 rows at most
    total, least = 0, 62
    for r in sorted(sizes, reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["b"]
    return 1 << least


def score(aligned: DataFrame) -> DataFrame:
    """The aligned rows with ``n_best`` and ``count_sum``, from counts over all of them. Read it from a written table."""
    spark = aligned.sparkSession
    counts = durable(pair_counts(aligned))
    least = _frequent(counts)
    common = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast([common.column(i).to_numpy() for i in range(3)])
    schema = T.StructType([*ALIGNED.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def work(batches):
        keys, numbers, best = known.value
        for batch in batches:
            pairs, times = [batch.column(i).flatten().to_numpy() for i in (7, 8)]
            sizes = batch.column(7).value_lengths().to_numpy()
            of_row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(sums[0], of_row[found], times[found] * best[at[found]])
            np.add.at(sums[1], of_row[found], times[found] * numbers[at[found]])
            rest = np.bincount(of_row[~found], minlength=batch.num_rows)
            left = [lists(x[~found], rest, pa.int64()) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *left, pa.array(sums[0]), pa.array(sums[1])], names=schema.names)

    scored = aligned.mapInArrow(work, schema)
    if counts.where(F.col("n") < least).isEmpty():
        return scored
    scored = durable(scored)
    rare = scored.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    joined = rare.join(counts.where(F.col("n") < least).hint("shuffle_merge"), "pair")
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    more = joined.groupBy("row").agg(F.sum(best).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))

    def total(name: str, other: str) -> Column:
        return F.col(name) + F.coalesce(F.col(other), F.lit(0).cast("long"))

    out = scored.join(more, "row", "left")
    return out.withColumns({"n_best": total("n_best", "more_best"), "count_sum": total("count_sum", "more_sum")}).drop("more_best", "more_sum")


def query(documents: DataFrame, json_path: str, model_path: str) -> DataFrame:
    aligned = durable(align(documents, json_path, model_path))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return score(aligned).select(*columns)
