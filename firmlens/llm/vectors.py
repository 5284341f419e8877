"""Vectors as integers, and blocks of them that travel as one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one block; what a task holds at once follows from it and not from the table.
BLOCK_ROWS = 4_096
# Integers whose squares, products and squared distances are summed exactly in doubles, over up to 2048 components.
EXACT = 1 << 20


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


def floored(column: str, factor: int) -> Column:
    """Components as integers, floor(factor * x) with x as a double; too large ones end the query instead of wrapping around."""
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * float(factor)))
    over = F.exists(scaled, lambda x: (x >= EXACT) | (x <= -EXACT))
    return F.when(over, F.raise_error(F.lit(f"a component is beyond {EXACT} after scaling"))).otherwise(F.transform(scaled, lambda x: x.cast("int")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows x width) doubles of a list column without nulls; shorter lists end in zeros."""
    offsets = np.asarray(column.offsets, np.int64)
    values = np.asarray(column.values, np.float64)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` at a time (fewer at the end)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            taken = batch.slice(0, rows - n)
            held.append(taken)
            n += taken.num_rows
            batch = batch.slice(taken.num_rows)
            if n == rows:
                yield _one(held)
                held, n = [], 0
    if n:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def widest(df: DataFrame, column: str) -> int:
    """Components of the longest vector."""
    return df.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0
