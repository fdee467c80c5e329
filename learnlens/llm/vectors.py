"""Vectors of an `array<float>` or `array<double>` column as bytes, so that tasks read them without a list per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def element(df: DataFrame, column: str) -> str:
    """The numpy type in which the column's components are exact."""
    return "<f4" if dict(df.dtypes)[column] == "array<float>" else "<f8"


def packed(df: DataFrame, column: str = "embedding") -> DataFrame:
    """`df` (an id column first, the vectors last) with the vectors as bytes, and their number of components as `dim`."""
    kind = element(df, column)
    others = [c for c in df.columns if c != column]
    wide = df.select(*others, F.col(column).cast("array<float>" if kind == "<f4" else "array<double>").alias(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(kind)).view(np.uint8)
            width = np.dtype(kind).itemsize
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            offsets = (np.append(0, np.cumsum(dims)) * width).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(dims), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), data, pa.array(dims, type=pa.int32())], names=[*others, column, "dim"])

    shape = ", ".join(f"{c} {t}" for c, t in wide.dtypes if c != column)
    return wide.mapInArrow(run, f"{shape}, {column} binary, dim int")


def matrix(cells: object, kind: str) -> np.ndarray:
    """Byte vectors of one length as rows of doubles."""
    rows = list(cells)
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)
