"""Vectorised word handling on the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; as those
bytes never occur inside a multi-byte character, this equals splitting the code
points.  Everything works on slices of whole rows of about ``SLICE_BYTES`` and
at most ``SLICE_ROWS``, so memory follows the slice and not the batch; a single
longer row is its own slice and costs a few machine words per word of text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 2048
BATCH_ROWS = 4000
SPAN_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def release() -> None:
    """Gives memory that a reused worker process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_batches(df, run: Callable, shape):
    """df.mapInArrow(run, shape), after which the worker keeps no freed memory.

    Rows hold whole texts, so Spark's default number of rows a batch becomes
    BATCH_ROWS in the session; another number set there is left alone.
    """
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(rows) == "10000":
        conf.set(rows, str(BATCH_ROWS))

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(freed, shape)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows."""
    buf, offs = string_buffers(column)
    n, lo = len(column), 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1), lo + most_rows)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which never cross a row's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offs] = True
    edge = border[:-1].copy()
    edge[1:] |= ~inside[:-1]
    starts = np.flatnonzero(inside & edge)
    edge = border[1:].copy()
    edge[:-1] |= ~inside[1:]
    return starts, np.flatnonzero(inside & edge) + 1


def rows_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, starts, "right") - 1


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    starts, ends = runs(~SPACE[buf], offs)
    return starts, ends, rows_of(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty or empty byte span, the same in every process."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lens = ends - starts
    total = np.concatenate(([0], np.cumsum(lens)))
    lo, n = 0, len(starts)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(total, total[lo] + SPAN_BYTES, "right")) - 1))
        part, first = lens[lo:hi], total[lo:hi] - total[lo]
        size = int(part.sum())
        if size == 0:
            out[lo:hi] = 0
        else:
            at = np.arange(size, dtype=np.int64) - np.repeat(first, part)
            values = _BYTE[buf[at + np.repeat(starts[lo:hi], part)]]
            values = values + (at.astype(np.uint64) >> np.uint64(12)) * _STEP
            values *= _MULT[at & 4095]
            full = part > 0
            got = np.zeros(hi - lo, np.uint64)
            got[full] = np.add.reduceat(values, first[full])
            out[lo:hi] = got
        lo = hi
    return mix(out + lens.astype(np.uint64) * _STEP)


def windows(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k word hashes; shorter than the input by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    lanes = _LANE[(np.arange(k) + salt * 23) % len(_LANE)]
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * lanes[j]
    return mix(out + np.uint64((k + 1000 * salt) * int(_STEP) & (1 << 64) - 1))


def inside_rows(rows: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie in one row."""
    n = len(rows) - k + 1
    return rows[:n] == rows[k - 1 :] if n > 0 else np.zeros(0, bool)


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n positions lie in a run of k that begins at one of the starts."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + k, -1)
    return np.cumsum(delta[:-1]) > 0


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (int64) or sums of each row."""
    got = np.bincount(rows, weights, n)
    return got.astype(np.int64) if weights is None or weights.dtype.kind in "bi" else got


def count_between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[ends] - total[starts]


def code_points(buf: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a code point."""
    return (buf & 0xC0) != 0x80


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
