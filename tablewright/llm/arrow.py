"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T


def with_fields(schema: T.StructType, **made: T.DataType) -> T.StructType:
    """The schema with the made fields last; they replace fields of the same name."""
    return T.StructType([f for f in schema.fields if f.name not in made] + [T.StructField(n, k) for n, k in made.items()])


def shares(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """The batch in slices of about ``most`` bytes in the given column; a longer value is a slice of its own."""
    if batch.num_rows:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(low), int(high - low))


def columns_of(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
