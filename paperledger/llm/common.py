"""Helpers shared by the corpus operators: Arrow text buffers, vectorised word hashing, stored tables.

The Python side of every operator works on whole Arrow batches. ``chunks`` cuts a batch into runs of
rows of about ``CHUNK_BYTES`` so that memory is bounded by the longest single text, never by a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from paperledger.session import ship
from paperledger.tables import Scratch, checkpoint_root, new_path, own

#: Bytes of text that are held as numpy arrays at a time (one longer text still goes in whole).
CHUNK_BYTES = 1 << 20

__all__ = ["Scratch", "checkpoint_root", "new_path", "own"]
_U = np.uint64
_MULT, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def series(n: int, seed: int) -> np.ndarray:
    """n well mixed uint64 values that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(_MULT))


BYTE_VALUE = series(256, 1) | _U(1)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean table over bytes that is true inside the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of bytes that are not a blank, tab, line feed, vertical tab, form feed or return.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII digits, lower-case letters and any non-ASCII character (after lower-casing A-Z).
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, CHUNK_BYTES + 1)
            self.up, self.down = (self._run(base, size) for base in (_STEP, pow(_STEP, -1, 1 << 64)))
        return self.up, self.down

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)


POWERS = Powers()


class Text:
    """Some rows of a text column as one byte array. ``first[i]:first[i + 1]`` are the bytes of row i."""

    def __init__(self, data: np.ndarray, first: np.ndarray) -> None:
        self.data, self.first = data, first

    def __len__(self) -> int:
        return len(self.first) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.first[i] : self.first[i + 1]].tobytes()


class Words:
    """Words of some rows: byte spans, row of each word, first word of each row, 64-bit hashes."""

    def __init__(self, text: Text, table: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER, hashed: bool = True) -> None:
        data = fold[text.data]
        self.data = data
        inside = table[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = text.first[(text.first > 0) & (text.first < len(data))]
        begin[cuts] |= inside[cuts]
        end[cuts - 1] |= inside[cuts - 1]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, text.first)
        self.count = np.diff(self.first)
        if hashed:
            up, down = POWERS.to(len(data))
            total = np.zeros(len(data) + 1, dtype=_U)
            np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.begin]) * down[self.begin])

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the runs of k words inside a row, in order, the first word of each, and the first run of each row."""
        n = len(self.begin)
        left = np.repeat(self.first[1:], self.count) - np.arange(n)
        at = np.flatnonzero(left >= k)
        value = np.zeros(len(at), dtype=_U)
        for j in range(k):
            value = value * _U(_STEP) + self.hash[at + j]
        first = np.concatenate(([0], np.cumsum(np.maximum(self.count - k + 1, 0))))
        return mix(value + _U(k)), at, first


def text_of(column: pa.Array) -> Text:
    """The bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[first[0] : first[-1]] if values is not None and len(values) else np.empty(0, dtype=np.uint8)
    return Text(data, first - first[0])


def chunks(batch: pa.RecordBatch, text_col: str = "text", size: int | None = None) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Slices of a batch of about ``size`` bytes of text, at least a row each, with their text."""
    if not batch.num_rows:
        return
    size = size or CHUNK_BYTES
    whole = text_of(batch.column(batch.schema.get_field_index(text_col)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(whole.first, whole.first[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        low, high = whole.first[start], whole.first[stop]
        yield batch.slice(start, stop - start), Text(whole.data[low:high], whole.first[start : stop + 1] - low)
        start = stop


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column whose row i is ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
