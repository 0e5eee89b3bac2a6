"""Vectorised work on the UTF-8 bytes of a column of texts.

Everything here runs inside a task on one slice of an Arrow batch: the bytes of
all texts of the slice lie in one array, and word borders, word hashes and
shingle hashes come from array operations over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes, which bounds a task's memory; a longer text is a slice alone.
SLICE_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNODD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers(dict):
    """Tables of this process; they are made anew where they are needed, never sent."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = n + n // 8  # slices are of much the same size
        for name, base in (("up", _ODD), ("down", _UNODD)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows within them) for runs of at most ``rows`` rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = min(max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1), first + rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: The separators of words that white space parts.
WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, ...]:
    """Starts and ends (bytes) of all words, and the index of each text's first word, with one more at the end."""
    n = len(data)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    border = offsets[(offsets > 0) & (offsets < n)]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, whatever its place."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text of each; a text of fewer words, but some, is one run."""
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for k, salt in enumerate(np.arange(1, size + 1, dtype=np.uint64) * _ODD):
        rolled += mix(hashes[k : n - size + 1 + k] + salt)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(np.arange(len(rolled)) + size <= first[owner[: len(rolled)] + 1]) if len(rolled) else np.zeros(0, int)
    out, texts = [mix(rolled[whole])], [owner[whole]]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[first[d] : first[d + 1]]
        salted = mix(own + np.arange(101, 101 + len(own), dtype=np.uint64) * _ODD)
        total = salted.sum(dtype=np.uint64)
        out.append(mix(np.array([total], np.uint64)))
        texts.append(np.array([d]))
    shingles, texts = np.concatenate(out), np.concatenate(texts)
    order = np.argsort(texts, kind="stable")
    return shingles[order], texts[order]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges (in order, not overlapping) as an Arrow array of strings."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    kept = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def by_value(batch: pa.RecordBatch, column: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The rows of a batch by the value of one column."""
    codes = batch.column(column).dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    for k, value in enumerate(codes.dictionary.to_pylist()):
        yield value, batch.take(pa.array(np.flatnonzero(at == k))) if len(codes.dictionary) > 1 else batch
