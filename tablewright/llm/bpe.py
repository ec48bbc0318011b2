"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merges come from a rank file (base64 token, rank). The library works on characters that stand for bytes, so a
byte-to-character table links both sides; decoding reverses it. Text is cut before every space that follows a
character other than white space: no match of the pattern spans that place. Each piece is encoded by the library
once and looked up afterwards, the common ones by later tasks too; texts with white space before a space go through the library whole.

Null texts count as empty: no ids, decoded to zero bytes. Empty tables give empty results. Rows are independent: ties,
repeated rows and extra columns pass through; a column called like a result column is replaced by it.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.arrow import columns_of, lists, shares, with_fields

#: Pieces that a task remembers; later ones are encoded whenever they come.
KEPT_PIECES = 150_000
#: Ids of pieces that a task remembers; beyond, it starts anew.
KEPT_IDS = 1 << 21
#: Pieces that stay for the next task of the same process.
KEPT_AFTER = 50_000
#: The pattern that the library has built in.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of several bytes: what is left after all merges of lower rank."""
    pairs = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            lowest, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if lowest >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every pair, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Codec:
    """Encoder and decoder of one rank file, with the pieces it has met."""

    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, shown = read_ranks(path), byte_characters()
        spell = {token: "".join(shown[b] for b in token) for token in ranks}
        model = models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=[(spell[a], spell[b]) for a, b in merge_list(ranks)])
        self.library = Tokenizer(model)
        if pattern in (None, USUAL):
            self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        else:
            steps = [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            self.library.pre_tokenizer = pre_tokenizers.Sequence(steps)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.sizes = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.at = np.zeros((2, 1 << 12), dtype=np.int64)
        self.together = re.compile(r"\s ")

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces and remember them. Those from a space to a visible character can be encoded as one text."""
        plain = [x[0] == " " and not x[-1].isspace() for x in pieces]
        joined = [x for x, p in zip(pieces, plain) if p]
        for low in range(0, len(joined), 4096):
            some = joined[low : low + 4096]
            (joined_up,) = self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)
            ids = np.array(joined_up.ids, dtype=np.int32)
            ends = np.cumsum(self.sizes[ids])
            borders = np.searchsorted(ends, np.cumsum([len(x.encode()) for x in some])) + 1
            self._keep(some, ids, np.diff(borders, prepend=0))
        alone = [x for x, p in zip(pieces, plain) if not p]
        for low in range(0, len(alone), 256):
            some = alone[low : low + 256]
            found = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
            self._keep(some, np.array([i for x in found for i in x], dtype=np.int32), np.array([len(x) for x in found]))

    def _keep(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, more = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + more > self.at.shape[1]:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)], axis=1)
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[0, n : n + more] = self.used + np.cumsum(counts) - counts
        self.at[1, n : n + more] = counts
        self.known.update(zip(pieces, range(n, n + more)))
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.known) > KEPT_PIECES:
            self._shorten(KEPT_PIECES)
        pieces, counts = [], []
        for text in texts:
            if not text:
                counts.append(0)
            elif self.together.search(text):
                pieces.append(text)
                counts.append(1)
            else:
                first, *rest = text.split(" ")
                own = [" " + x for x in rest]
                if first:
                    own.insert(0, first)
                pieces += own
                counts.append(len(own))
        self._learn([x for x in dict.fromkeys(pieces) if x not in self.known])
        which = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        sizes = self.at[1, which]
        ids = gather(self.flat, self.at[0, which], sizes)
        of_text = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])
        if self.used > KEPT_IDS:
            self.known, self.used = {}, 0
        return ids, np.diff(before[of_text])

    def _shorten(self, most: int) -> None:
        """Keep the first pieces that came: they are the common ones."""
        self.known = dict(islice(self.known.items(), most))
        self.used = int(self.at[:, most - 1].sum())

    def forget(self) -> None:
        """Drop all but the common pieces, whose memory the next work of the same process may need."""
        if len(self.known) > KEPT_AFTER:
            self._shorten(KEPT_AFTER)
        n = len(self.known)
        self.flat = np.concatenate([self.flat[: self.used], np.zeros(1 << 16, dtype=np.int32)])
        self.at = np.concatenate([self.at[:, :n], np.zeros((2, 1 << 12), dtype=np.int64)], axis=1)
        pa.default_memory_pool().release_unused()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        return gather(self.bytes, self.starts[ids], self.sizes[ids])


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str | None) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def character_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; a token that holds part of a character spans it."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return character[ends - sizes], character[ends - 1] + 1


def encode(df: DataFrame, ranks_path: str, pattern: str | None = None, text: str = "text", offsets: bool = False) -> DataFrame:
    """Add ``ids``; with ``offsets`` also ``token_starts`` and ``token_ends`` in characters (end exclusive).

    pattern None means the usual byte-level pattern built into the library.
    """
    ints = T.ArrayType(T.IntegerType())
    made = {"ids": ints} | ({"token_starts": ints, "token_ends": ints} if offsets else {})
    kept, at = [f.name for f in df.schema.fields if f.name not in made], df.columns.index(text)

    def work(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for part in shares(batch, at):
                texts = part.column(at).to_pylist()
                ids, counts = own.encode(texts)
                out = columns_of(part, kept) + [lists(ids, counts, pa.int32())]
                if offsets:
                    cuts = np.cumsum(counts)
                    spans = [character_spans(t or "", own.sizes[ids[e - n : e]]) for t, n, e in zip(texts, counts, cuts)]
                    out += [lists(np.concatenate([s[k] for s in spans]), counts, pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(out, names=[*kept, *made])
        own.forget()

    return df.mapInArrow(work, with_fields(df.schema, **made))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (bytes) and ``decoded_text``, where bytes that form no character become U+FFFD."""
    made = {"decoded": T.BinaryType(), "decoded_text": T.StringType()}
    kept, at = [f.name for f in df.schema.fields if f.name not in made], df.columns.index(ids)

    def work(batches):
        own = codec(ranks_path, None)
        for batch in batches:
            raw = [own.decode(np.array(x or [], dtype=np.int64)).tobytes() for x in batch.column(at).to_pylist()]
            out = columns_of(batch, kept)
            out += [pa.array(raw, type=pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], type=pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *made])

    return df.mapInArrow(work, with_fields(df.schema, **made))


def round_trip(df: DataFrame, ranks_path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``ids`` of each text and ``decoded``, the bytes that the ids stand for, in one pass over the table."""
    made = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType()}
    kept, at = [f.name for f in df.schema.fields if f.name not in made], df.columns.index(text)

    def work(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for part in shares(batch, at):
                ids, counts = own.encode(part.column(at).to_pylist())
                ends = np.concatenate([[0], np.cumsum(own.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own.decode(ids))])
                out = columns_of(part, kept)
                yield pa.RecordBatch.from_arrays([*out, lists(ids, counts, pa.int32()), raw], names=[*kept, *made])
        own.forget()

    return df.mapInArrow(work, with_fields(df.schema, **made))


def digests(df: DataFrame, *more: str) -> DataFrame:
    """Number and SHA-256 of the ids, SHA-256 of the decoded bytes, and further columns."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *more,
    )
