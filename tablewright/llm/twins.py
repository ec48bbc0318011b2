"""Which fingerprints occur more than once in the corpus? Rounds over packed chunks of documents.

Documents are packed into chunks, compressed Arrow batches of about ``CHUNK_BYTES`` of text, in a table bucketed by
chunk, so that no later join moves the texts. In a round, every chunk tells its distinct fingerprints, each once however
often the chunk holds it, dealt to shares by their first bits; a share is judged in one task and answers a byte per
fingerprint and chunk; the answers go back to the chunks, which work out the same fingerprints again, in the same
order. So a passage in a third of all documents costs one number per chunk, rows are never gathered by key, and what is
shuffled is compact. A share holds the corpus' fingerprints divided by ``SHARES_PER_PARTITION`` times the shuffle
partitions, so its size is set by that setting; chunks come in a fixed order, so that a repeated task answers alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrow import shares
from tablewright.plans.durable import scratch_path

CHUNK_BYTES = 2 << 20
SHARES_PER_PARTITION = 4
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def pack(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``chunk`` and ``body``: documents as compressed Arrow batches with the columns id and text."""
    narrow = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))

    def work(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in shares(batch, 1, CHUNK_BYTES // 4):
                held.append(part)
                size += part.column(1).nbytes
                if size >= CHUNK_BYTES:
                    yield _body(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _body(number, held)

    spark, name = docs.sparkSession, f"chunks_{uuid.uuid4().hex}"
    packed = narrow.mapInArrow(work, "chunk bigint, body binary")
    packed.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _body(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "body"])


def given_id(column: str = "doc_id") -> Column:
    """The id as it was given."""
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(column)


def unpack(body: bytes) -> tuple[np.ndarray, list[str | None]]:
    table = pa.ipc.open_stream(body).read_all()
    return table.column("id").to_numpy(), table.column("text").to_pylist()


def told(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in ascending order, place of each given one among them, and for folds: order and firsts."""
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(prints), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ordered[first], place, order, first


def fold(how: np.ufunc, values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return how.reduceat(values[order], first) if len(first) else values[:0]


def round_(
    chunks: DataFrame, emit: Callable[[dict], dict[str, np.ndarray]],
    judge: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], width: int = 8, columns: dict[str, str] | None = None,
) -> DataFrame:
    """``chunk`` and ``answers``: one byte for each fingerprint that ``emit`` tells of the chunk, in that order.

    emit gets the chunk's row and tells ``prints``, distinct and ascending, and the further columns. judge gets the
    last ``width`` bytes of all fingerprints of a share, chunk by chunk, and their further columns.
    """
    kinds, spark = columns or {}, chunks.sparkSession
    count = SHARES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        for chunk in rows_of(batches):
            more = emit(chunk)
            prints = more["prints"]
            share = ((prints >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            edges = np.flatnonzero(np.diff(share, prepend=np.uint64(count))) if len(prints) else np.zeros(0, dtype=int)
            pairs = list(zip(edges, [*edges[1:], len(prints)]))
            low = np.ascontiguousarray(prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
            arrays = [pa.array(share[edges].astype(np.int32)), pa.array([chunk["chunk"]] * len(pairs), pa.int64())]
            for values in (low, *[more[n].astype(k) for n, k in kinds.items()]):
                arrays.append(pa.array([values[a:b].tobytes() for a, b in pairs], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["share", "chunk", "prints", *kinds])

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        raw = table.column("prints").to_pylist()
        sizes = np.array([len(x) // width for x in raw])
        prints = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
        prints[:, :width] = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, width)
        more = {n: np.frombuffer(b"".join(table.column(n).to_pylist()), dtype=k) for n, k in kinds.items()}
        said, ends = judge(prints.view("<u8").ravel(), more).astype(np.uint8), np.cumsum(sizes)
        parts = [said[e - n : e].tobytes() for e, n in zip(ends, sizes)]
        return pa.table({"chunk": table.column("chunk"), "share": table.column("share"), "answer": pa.array(parts, pa.binary())})

    fields = "share int, chunk bigint, prints binary" + "".join(f", {n} binary" for n in kinds)
    said = chunks.mapInArrow(deal, fields).groupBy("share").applyInArrow(answer, "chunk bigint, share int, answer binary")
    return said.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("share", "answer"))).alias("answers"))


def with_answers(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The chunks with a round's answers, as a list of bytes."""
    return chunks.join(answers.select("chunk", F.col("answers.answer").alias(name)), "chunk", "left")


def read_answers(parts: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(parts or []), dtype=np.uint8)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {n: batch.column(k)[row].as_py() for k, n in enumerate(batch.schema.names)}


def groups(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first places and sizes of the groups of equal fingerprints; the order keeps that of the chunks."""
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(prints) else np.zeros(0, dtype=int)
    return order, first, np.diff(np.append(first, len(prints)))


def together(how: np.ufunc, values: np.ndarray, order: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each fingerprint the fold of its group's values."""
    out = np.empty(len(values), dtype=values.dtype)
    if len(first):
        out[order] = np.repeat(how.reduceat(values[order], first), sizes)
    return out
