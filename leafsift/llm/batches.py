"""Arrow batches as numpy arrays: bounded slices, words, lines, dictionaries."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.session import release, stored, tidy  # noqa: F401  used by the operators of this folder

#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 2 << 20

#: White space between words: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; others, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # no glibc
    _trim = None


def give_back() -> None:
    """Hand freed memory back to the system: several workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (one row if it is longer)."""
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
            done += 1
            if done % 4 == 0:
                give_back()
    give_back()  # the worker may idle while others need the memory


def per_slice(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``work`` on every bounded slice of (doc_id, text)."""

    def run(batches):
        for part in slices(batches, limit):
            out = work(part)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return texts_of(docs).mapInArrow(run, schema)


def spread_repeats(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, one after another."""
    counts = np.asarray(counts, dtype=np.int64)
    starts = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(starts, counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+counts[i]-1 for every i, one after another."""
    return np.repeat(np.asarray(starts, dtype=np.int64), counts) + spread_repeats(counts)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], where the bounds run from 0 to len(values)."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=kind)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=kind)
    return out


def dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's number among the distinct ones, and how many there are."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)


def firsts(ids: np.ndarray, kinds: int) -> np.ndarray:
    """Whether each of the dense numbers ``ids`` stands for the first time."""
    place = np.empty(kinds, dtype=np.int64)
    place[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    out = np.zeros(len(ids), dtype=bool)
    out[place] = True
    return out


class HashTable:
    """From 64-bit keys (0 or more) to two numbers, looked up for whole arrays."""

    def __init__(self, size: int = 1 << 16):
        self.keys = np.full(size, -1, np.int64)
        self.value = np.zeros(size, np.int32)
        self.extra = np.zeros(size, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(20)).astype(np.int64) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, -1 if it is not there."""
        at = self._slots(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (held != -1)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return out

    def add(self, key: int, value: int, extra: int = 0) -> None:
        """A key that is not there yet."""
        if 2 * self.used >= len(self.keys):
            full = np.flatnonzero(self.keys != -1)
            old = zip(self.keys[full].tolist(), self.value[full].tolist(), self.extra[full].tolist())
            self.__init__(2 * len(self.keys))
            for entry in old:
                self._put(*entry)
        self._put(key, value, extra)

    def _put(self, key: int, value: int, extra: int) -> None:
        mask = len(self.keys) - 1
        at = ((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20) & mask
        while self.keys[at] != -1:
            at = (at + 1) & mask
        self.keys[at], self.value[at], self.extra[at] = key, value, extra
        self.used += 1


@dataclass
class Bytes:
    """The texts of a batch as one run of UTF-8 bytes; text i is data[bounds[i]:bounds[i + 1]]. Null is empty."""

    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Bytes:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column):
            bounds = np.zeros(1, dtype=np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[bounds[0] : bounds[-1]] if body else np.zeros(0, np.uint8)
        return cls(data, bounds - bounds[0])

    def __len__(self) -> int:
        return len(self.bounds) - 1


def pack(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings data[offsets[i]:offsets[i + 1]] as an Arrow array, without a Python object each."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


@dataclass
class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a batch.

    ``starts`` are places in the batch's bytes, ``first[i]`` is the number of the
    first word of text i, ``ids`` numbers equal words alike, ``distinct`` holds each once.
    """

    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    distinct: pa.Array

    @classmethod
    def of(cls, raw: Bytes) -> Words:
        solid = ~IS_SPACE[raw.data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edges = raw.bounds[:-1]
        edges = edges[edges < len(raw.data)]
        begins[edges] = solid[edges]
        starts = np.flatnonzero(begins)
        packed = raw.data[solid]
        offsets = np.append(np.flatnonzero(begins[solid]), len(packed)).astype(np.int64)
        found = pack(packed, offsets).dictionary_encode()
        return cls(
            starts,
            np.diff(offsets),
            np.searchsorted(starts, raw.bounds).astype(np.int64),
            found.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            found.dictionary,
        )

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def lengths_of(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
