"""Whole-number vectors out of float arrays, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LIMIT = 1 << 24  # of a component: squares of differences over 1024 components stay below 2^62


def whole_numbers(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the rows of a list column with exactly `dims` components, none null or not finite, and their
    floor(256 * x) as int32. Values beyond LIMIT are a ValueError."""
    lists = lists.cast(pa.large_list(pa.float64()))
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists.take(pa.array(rows, pa.int64())))
    if not len(rows):
        return rows, np.zeros((0, dims), np.int32)
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(values).all(axis=1)  # a null component is NaN here
    values = np.floor(SCALE * values[good])
    if (np.abs(values) >= LIMIT).any():
        raise ValueError(f"a component times {SCALE} is {LIMIT} or more")
    return rows[good], values.astype(np.int32)


def packed(df: DataFrame, columns: dict[str, Column], vector: str, dims: int) -> DataFrame:
    """`columns` (simple types) and v binary, the vector as little-endian int32; rows without a proper vector are left out."""
    given = df.select(*[c.alias(n) for n, c in columns.items()], F.col(vector).alias("v"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "v")
    names = list(columns)

    def run(batches):
        for batch in batches:
            rows, values = whole_numbers(batch.column("v"), dims)
            own = [batch.column(n).take(pa.array(rows, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([*own, rows_of(values)], [*names, "v"])

    return given.mapInArrow(run, f"{types}, v binary")


def rows_of(values: np.ndarray) -> pa.Array:
    """A matrix as a binary column, one row each."""
    width = values.shape[1] * values.itemsize
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(width), len(values), [None, data]).cast(pa.binary())


def matrix(column: pa.Array, dims: int, dtype=np.int32) -> np.ndarray:
    """The rows of a binary column written by rows_of()."""
    data = column.cast(pa.large_binary())
    if not len(data):
        return np.zeros((0, dims), dtype)
    _, offsets, raw = data.buffers()
    offsets = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(-1, dims)
