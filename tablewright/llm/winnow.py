"""Document fingerprints by winnowing.

Every run of ``K`` code points has a rolling hash of 48 bits; of every ``W`` consecutive hashes the smallest is chosen, the
rightmost of equal ones, and kept with its position. Two texts that share a passage of at least ``K + W - 1`` code points
therefore share a chosen hash. A text with fewer than ``W`` hashes is one window, one of fewer than ``K`` code points one hash.

Null texts count as empty: no hashes. Equal texts have equal fingerprints, wherever they are. The likeness of two
fingerprints is the share of common hashes among all their distinct hashes; two empty ones are alike. Very long texts are
hashed in segments of ``SEGMENT`` windows that overlap, so the result is that of the whole text.

For the order of the documents rows are taken by id, null ids last, equal ids by a hash of the text; equal rows are
interchangeable, so that all give the same set of results. A single document is its own next one. Extra columns pass
through ``fingerprints``, where a column called like a result column is replaced; the query reads id and text only. Empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.arrow import columns_of, lists, shares, with_fields
from tablewright.llm.rolling import mix
from tablewright.plans.ordered import windowed

#: Code points of a hash, and hashes of a window.
K, W = 24, 64
#: Windows that are searched at once; positions inside have 16 bits.
SEGMENT = 1 << 15
_MULTIPLIER = 0xD1342543DE82EF95
_LOW, _HIGH = np.uint64((1 << 16) - 1), np.uint64((1 << 64) - (1 << 16))
_NONE = np.uint64((1 << 64) - 1)


def hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mixed polynomials of codes[start : start + size], by running sums modulo 2**64."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up = np.full(len(codes) + 1, pow(_MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    up[0] = 1
    down = np.full(len(codes) + 1, _MULTIPLIER, dtype=np.uint64)
    down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix((sums[starts + sizes] - sums[starts]) * down[starts])


def _segments(n: int, k: int, w: int) -> list[tuple[int, int]]:
    """Borders, in code points, of the overlapping segments that cover every window of a text once."""
    last = max(1, n - k - w + 2)
    return [(low, min(n, low + SEGMENT + k + w - 2)) for low in range(0, last, SEGMENT)]


def _chosen(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and position of the chosen hashes of short pieces of text (at most SEGMENT windows each)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    grams = np.where(lengths > 0, np.maximum(1, lengths - k + 1), 0)
    slots = np.where(grams > 0, np.maximum(grams, w), 0)
    first = np.cumsum(slots) - slots
    of_gram = np.repeat(np.arange(len(texts)), grams)
    inside = np.arange(len(of_gram)) - np.repeat(np.cumsum(grams) - grams, grams)
    found = hashes(codes, begins[of_gram] + inside, np.minimum(k, lengths)[of_gram])
    keys = np.full(int(slots.sum()), _NONE)
    # the smallest key of a window is its smallest hash, and of equal hashes the rightmost
    keys[first[of_gram] + inside] = (found & _HIGH) | (_LOW - inside.astype(np.uint64))
    width = 1
    while 2 * width <= w:
        keys = np.minimum(keys[: len(keys) - width], keys[width:])
        width *= 2
    if width < w:
        keys = np.minimum(keys[: len(keys) - w + width], keys[w - width :])
    of_window = np.repeat(np.arange(len(texts)), np.where(slots > 0, slots - w + 1, 0))
    at = np.arange(len(of_window)) - np.repeat(np.cumsum(np.where(slots > 0, slots - w + 1, 0)) - np.where(slots > 0, slots - w + 1, 0), np.where(slots > 0, slots - w + 1, 0))
    best = keys[first[of_window] + at] if len(of_window) else keys[:0]
    place = (_LOW - (best & _LOW)).astype(np.int64)
    new = np.ones(len(best), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (of_window[1:] != of_window[:-1])
    return of_window[new], (best[new] >> np.uint64(16)).astype(np.int64), place[new]


def winnow(texts: list[str | None], k: int = K, w: int = W, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of all texts one after the other, and how many each text has."""
    pieces = [(i, low, t[low:high]) for i, t in enumerate(texts) if t for low, high in _segments(len(t), k, w)]
    out, start, size = [], 0, 0
    for end, (_, _, piece) in enumerate(pieces, 1):
        size += len(piece)
        if size >= most or end == len(pieces):
            some = pieces[start:end]
            number, values, place = _chosen([p for _, _, p in some], k, w)
            owner, low = np.array([i for i, _, _ in some])[number], np.array([a for _, a, _ in some])[number]
            out.append((owner, values, place + low))
            start, size = end, 0
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    owner, values, place = (np.concatenate([o[i] for o in out]) for i in range(3))
    new = np.ones(len(owner), dtype=bool)  # neighbouring segments may choose the same hash
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    return values[new], place[new], np.bincount(owner[new], minlength=len(texts))


def fingerprints(df: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Add ``hashes`` and ``positions`` (in code points), in the order of the text."""
    made = {"hashes": T.ArrayType(T.LongType()), "positions": T.ArrayType(T.LongType())}
    kept, at = [f.name for f in df.schema.fields if f.name not in made], df.columns.index(text)

    def work(batches):
        for batch in batches:
            for part in shares(batch, at):
                values, place, counts = winnow(part.column(at).to_pylist(), k, w)
                columns = [lists(x, counts, pa.int64()) for x in (values, place)]
                yield pa.RecordBatch.from_arrays([*columns_of(part, kept), *columns], names=[*kept, *made])

    return df.mapInArrow(work, with_fields(df.schema, **made))


def likeness(a: str, b: str) -> Column:
    """Share of the common among the distinct hashes of two columns of hashes; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def said(hashes: str, positions: str) -> Column:
    """Hashes and positions as text: hash in hex, colon, position, joined by commas."""
    return F.array_join(F.zip_with(hashes, positions, lambda h, p: F.concat(F.lower(F.hex(h)), F.lit(":"), p.cast("string"))), ",")


def with_next(documents: DataFrame) -> DataFrame:
    """Id and text of every document with the text of the next one by descending id; the first follows the last.

    The table is cut into chunks of consecutive ids, four for each shuffle partition; only the rows at the borders are copied.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    rows = documents.select("doc_id").count()
    chunks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    previous = windowed(
        docs, [], ["doc_id", "_hash"], lambda win: {"_next": F.lag("text").over(win)},
        before=1, rows=rows, chunk_rows=max(1, -(-rows // chunks)),
    )
    largest = documents.agg(F.max("doc_id")).first()[0]
    top = docs.where(F.col("doc_id").eqNullSafe(F.lit(largest).cast(docs.schema["doc_id"].dataType)))
    # the text has no nulls, so the one row without a next text is that of the smallest id
    top = top.agg(F.max_by("text", "_hash"))
    return previous.select("doc_id", "text", F.coalesce("_next", top.scalar()).alias("next_text"))


def query(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and the likeness to the edited and to the next text."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    start = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = F.concat(start, F.substring("next_text", F.lit(1), half))
    docs = with_next(documents).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    made = {f"{p}_{n}": T.ArrayType(T.LongType()) for p in ("own", "edited", "next") for n in ("hashes", "positions")}
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType())]
                          + [T.StructField(n, k) for n, k in made.items()])
    docs = docs.select(F.col("doc_id").cast("long"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited", "next_text")

    def work(batches):
        for batch in batches:
            for part in shares(batch, 3):
                texts, changed, after = (part.column(i).to_pylist() for i in (3, 4, 5))
                # most next texts are a text of the same share: hash each of them once
                unique = {t: i for i, t in enumerate(dict.fromkeys([*texts, *changed, *after]))}
                values, place, counts = winnow(list(unique))
                ends = np.cumsum(counts)
                out = list(part.columns[:3])
                for column in (texts, changed, after):
                    which = np.array([unique[t] for t in column])
                    sizes = counts[which]
                    at = np.repeat(ends[which] - np.cumsum(sizes), sizes) + np.arange(sizes.sum()) if len(which) else which
                    out += [lists(x[at], sizes, pa.int64()) for x in (values, place)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    found = docs.mapInArrow(work, schema)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", said("own_hashes", "own_positions").alias("fingerprint"),
        said("edited_hashes", "edited_positions").alias("edited_fingerprint"),
        likeness("own_hashes", "edited_hashes").alias("near_edited"), likeness("own_hashes", "next_hashes").alias("near_next"),
    )
