"""Counting quotient filters: exact, compact, mergeable tables of (key, count).

A key is a tuple of k numbers of ``bits`` bits each. An invertible permutation scrambles the tuple; the leading bits
of what comes out are the quotient, all other bits the remainder, and both are kept, so every key comes back. Entries lie
sorted; a filter stores

* for each quotient, in unary, how many entries it has,
* the remainders in whole bytes,
* the counts less one, a byte each, with an escape to eight bytes.

Filters of different parts of the data, whatever their sizes, are merged by merging their sorted entries.
"""

from __future__ import annotations

import struct

import numpy as np

from tidewatch.llm.spans import mix

_ROUNDS = 3
_HEAD = "<qqqq"  # entries, numbers of a key, quotient bits, shard
_SALTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _turns(k: int) -> list[tuple[int, int, int]]:
    """(place that changes, place it depends on, salt) one after another."""
    return [(r % k, (r + 1) % k, r) for r in range(_ROUNDS * k)]


def permuted(key: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """The key scrambled one to one within its bits, or brought back; each turn changes one number by a hash of another."""
    key = list(key)
    turns = _turns(len(key)) if len(key) > 1 else []
    for changed, by, salt in reversed(turns) if back else turns:
        key[changed] = key[changed] ^ mix(key[by] + _SALTS[salt]) >> np.uint64(64 - bits)
    return key


def in_order(key: list[np.ndarray]) -> np.ndarray:
    """The order of permuted keys; runs that are sorted already are merged."""
    order = np.argsort(key[0], kind="stable")
    first = key[0][order]
    ties = np.flatnonzero(first[1:] == first[:-1])
    rest = [part[order] for part in key[1:]]
    if len(ties) and any((part[ties] != part[ties + 1]).any() for part in rest):
        order = np.lexsort(key[::-1])
    return order


def summed(key: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted keys sorted, equal ones as one with the sum of their counts."""
    if not len(counts):
        return key, counts
    order = in_order(key)
    key, counts = [part[order] for part in key], counts[order]
    new = np.ones(len(counts), bool)
    new[1:] = np.logical_or.reduce([part[1:] != part[:-1] for part in key])
    at = np.flatnonzero(new)
    return [part[at] for part in key], np.add.reduceat(counts, at)


def _bytes_of(numbers: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _numbers_of(data: bytes, n: int, size: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    return wide.view("<u8").ravel().astype(np.uint64)


def packed(key: list[np.ndarray], counts: np.ndarray, bits: int, shard_bits: int) -> bytes:
    """A filter of sorted, different, permuted keys that share their first ``shard_bits`` bits."""
    n, k = len(counts), len(key)
    q = min(max(int(n).bit_length() - 1, 0), bits - shard_bits)
    low = bits - shard_bits - q  # of the first number, what is neither shard nor quotient
    own = key[0] & np.uint64((1 << (bits - shard_bits)) - 1) if bits > shard_bits else np.zeros(n, np.uint64)
    quotient = (own >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
    unary = np.zeros((1 << q) + n, bool)
    unary[quotient + np.arange(n)] = True
    shard = int(key[0][0]) >> (bits - shard_bits) if shard_bits else 0
    big = np.flatnonzero(counts > 255)
    small = np.where(counts > 255, 255, counts - 1).astype(np.uint8)
    rest = own & np.uint64((1 << low) - 1)
    parts = [struct.pack(_HEAD, n, k, q, shard), np.packbits(unary).tobytes(), _bytes_of(rest, -(-low // 8))]
    parts += [_bytes_of(part, -(-bits // 8)) for part in key[1:]]
    return b"".join([*parts, small.tobytes(), counts[big].astype("<i8").tobytes()])


def unpacked(data: bytes, bits: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The permuted keys, sorted, and the counts."""
    n, k, q, shard = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    size = -(-((1 << q) + n) // 8)
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at))[: (1 << q) + n]) - np.arange(n)
    at += size
    low = bits - shard_bits - q
    key = []
    for size in (-(-low // 8), *[-(-bits // 8)] * (k - 1)):
        key.append(_numbers_of(data[at : at + n * size], n, size))
        at += n * size
    key[0] |= quotient.astype(np.uint64) << np.uint64(low)
    if shard_bits:
        key[0] |= np.uint64(shard << (bits - shard_bits))
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64) + 1
    counts[counts == 256] = np.frombuffer(data, "<i8", -1, at + n)
    return key, counts


def merged(filters: list[bytes], bits: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The permuted keys of several filters of one shard and their summed counts."""
    parts = [unpacked(data, bits, shard_bits) for data in filters]
    return summed([np.concatenate(x) for x in zip(*(key for key, _ in parts))], np.concatenate([counts for _, counts in parts]))
