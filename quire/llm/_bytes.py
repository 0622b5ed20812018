"""Vectorised work on the UTF-8 bytes of Arrow string columns, shared by the operators that run inside tasks.

Texts are handled in slices of bounded bytes, so a task holds a few arrays of a slice's size at once.
A text that is longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IDENTITY = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base, or of its inverse, modulo 2^64; no more than a slice needs stays in memory."""
    have = _powers[kind]
    base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
    while len(have) < min(n, SLICE_BYTES + 1):
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have[: SLICE_BYTES + 1 - len(have)] * step])
        _powers[kind] = have
    if n <= len(have):
        return have[:n]
    out = np.empty(n, np.uint64)
    for k in range(0, n, len(have)):
        part = out[k : k + len(have)]
        np.multiply(have[: len(part)], np.uint64(pow(base, k, 1 << 64)), out=part)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of the batches with about `most` bytes of text each: (slice, bytes, offsets)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that do not cross texts: starts, ends, and for each text the range of its runs (n + 1 pointers)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[offsets < n]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: starts, ends, pointers by text."""
    return spans(~SPACE[data], offsets)


class Hasher:
    """64-bit hashes of byte spans, after mapping each byte by the table; the prefix sums serve any number of span sets."""

    def __init__(self, data: np.ndarray, table: np.ndarray = LOWER):
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        part = table[data].astype(np.uint64)
        part += np.uint64(1)
        part *= _power_table("up", len(data))
        np.cumsum(part, out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * _power_table("down", len(self.total))[starts])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    return Hasher(data, table).of(starts, ends)


def hash_one(word: bytes, table: np.ndarray = LOWER) -> int:
    """The hash of a single span, as hashes() gives it."""
    data = np.frombuffer(word, np.uint8)
    return int(hashes(data, np.zeros(1, np.int64), np.full(1, len(data)), table)[0])


def runs_of(lengths: np.ndarray) -> np.ndarray:
    """Start pointers of runs with these lengths (n + 1)."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each run, one after the other."""
    ptr = runs_of(lengths)
    if ptr[-1] == 0:
        return np.zeros(0, np.int64)
    out = np.ones(ptr[-1], np.int64)
    full = lengths > 0
    first, begin, size = ptr[:-1][full], starts[full], lengths[full]
    out[first[0]] = begin[0]
    out[first[1:]] = begin[1:] - begin[:-1] - size[:-1] + 1
    return np.cumsum(out)
