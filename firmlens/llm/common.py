"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.session import cut_lineage, scratch_path

__all__ = [
    "WordStore", "byte_buckets", "checked_broadcast", "cut_lineage", "documents", "flat_text", "offsets_of", "read", "rebatched", "running_starts", "scratch_path",
    "text_bytes", "tokenizer_path",
]

# Bytes of text that one step of a Python task looks at; bounds its memory whatever the batch size of the session.
STEP_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is installed on every node and never copied."""
    import public_tokenizers

    return str(PurePosixPath(public_tokenizers.path(name)))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


# Rows of a narrow frame (ids, terms) that may be sent to every task; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; give it frames that are cheap to read twice."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def byte_buckets(df: DataFrame, nbytes: Column, target: int, least: int = 1) -> int:
    """How many buckets of about ``target`` bytes the frame needs; one aggregate over one column."""
    total = df.agg(F.sum(nbytes).alias("n")).first()["n"] or 0
    return max(least, -(-int(total) // target))


def give_back() -> None:
    """Hand freed memory back to the system: workers are kept for later tasks, and what they hold on to is missing there."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def rebatched(batches: Iterator[pa.RecordBatch], size_of: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text has about ``limit`` bytes at most (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(offsets_of(batch.column(batch.schema.get_field_index(size_of)))))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        give_back()


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, nulls as empty, relative to its own slice."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=width) if column.buffers()[1] else np.zeros(1, width)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    offsets = offsets_of(column)
    if not column.buffers()[2]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def running_starts(parts: DataFrame, key: str, n: str) -> DataFrame:
    """``start``: sum of ``n`` over all smaller ``key``; the frame has one row per part file or bucket, never per document."""
    rows = sorted(parts.select(key, n).toLocalIterator(), key=lambda r: r[0])
    starts, total = [], 0
    for r in rows:
        starts.append((r[0], total))
        total += int(r[1])
    kind = dict(parts.dtypes)[key]
    return parts.sparkSession.createDataFrame(starts, f"{key} {kind}, start long")


class WordStore:
    """Ids (and another number of each) of words that a task has met; ``learn`` is asked for new words only.

    The store is started anew when it would hold more than ``limit`` words, which bounds its memory and only costs time.
    """

    def __init__(self, learn, limit: int = 400_000):
        self.learn, self.limit = learn, limit
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.counts, self.ids, self.more = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the store."""
        missing = [w for w in words if w not in self.place]
        if missing:
            if len(self.place) + len(missing) > self.limit and self.place:
                self._empty()
                missing = words
            counts, ids, more = self.learn(missing)
            self.place.update(zip(missing, range(len(self.place), len(self.place) + len(missing)), strict=True))
            self.counts = np.concatenate([self.counts, counts])
            self.ids, self.more = np.concatenate([self.ids, ids]), np.concatenate([self.more, more])
            self.first = np.cumsum(self.counts) - self.counts
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each id of a run of words stands in the store, end of each word in that run)."""
        n = self.counts[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(self.first[which] - (ends - n), n) + np.arange(total), ends
