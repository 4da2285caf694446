"""Vectorised text kernels over Arrow buffers: words, rolling hashes and window minima.

All work on one concatenated buffer of a batch's texts with the offsets of the
texts in it, so their cost is a few passes over the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True  # the white space of the contracts: \x09-\x0D and \x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverses modulo 2**64, for i below n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]).astype(np.uint64).cumprod(dtype=np.uint64)
        _inverses = np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]).astype(np.uint64).cumprod(dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


def binary_array(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over given bytes and offsets."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]
    ).cast(pa.binary())


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each text (with the end)."""
    inside = ~BLANK[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(buf) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(buf) else inside
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    base = np.cumsum(size) - size
    within = np.arange(base[-1] + size[-1]) - np.repeat(base, size)
    power = powers(int(size.max()) + 1)[0]
    return mix(np.add.reduceat(_SYMBOL[buf[within + np.repeat(start, size)]] * power[within], base) + size.astype(np.uint64))


def byte_units(buf: np.ndarray) -> np.ndarray:
    return _SYMBOL[buf]


def rolling(units: np.ndarray, k: int, mixed: bool = True) -> np.ndarray:
    """A 64-bit hash of every k consecutive units, by doubling; unmixed, its lower bits are weak."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, covered, block, size = None, 0, units, 1
    base = int(_BASE)
    while True:
        scale = np.uint64(pow(base, size, 1 << 64))
        if k & size:
            done = block if done is None else done[: len(block) - covered] * scale + block[covered : covered + len(done)]
            covered += size
        if size * 2 > k:
            return mix(done[:n]) if mixed else done[:n]
        block = block[:-size] * scale + block[size:]
        size *= 2


def range_hashes(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of units."""
    power, inverse = powers(len(units) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * power[: len(units)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def winnow(units: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor unit, its hash, first window, last window, text).

    A window's anchor is its leftmost k-gram of least hash, so equal windows have
    equal anchors at equal places wherever they stand.
    """
    empty = (np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if len(units) < window:
        return empty
    grams = rolling(units, k)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keys, window - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    ok = np.zeros(len(anchor), dtype=bool)
    long_ = np.flatnonzero(sizes >= window)
    ok[ranges(offsets[long_], sizes[long_] - window + 1)] = True
    if not ok.any():
        return empty
    change = np.empty(len(anchor), dtype=bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    first = np.flatnonzero(ok & (change | ~np.concatenate([[False], ok[:-1]])))
    last = np.flatnonzero(ok & np.concatenate([change[1:] | ~ok[1:], [True]]))
    at = anchor[first]
    return at, grams[at], first, last, np.searchsorted(offsets, first, side="right") - 1


def refine(order: np.ndarray, heads: np.ndarray, key_of) -> None:
    """Sort, in place, each run of ties by a further key; heads marks where runs begin."""
    run = np.cumsum(heads) - 1
    tied = np.flatnonzero(np.bincount(run)[run] > 1)
    if not len(tied):
        return
    key, r = key_of(order[tied]), run[tied]
    perm = np.lexsort((key, r))
    order[tied] = order[tied][perm]
    key = key[perm]
    heads[tied[1:]] |= (key[1:] != key[:-1]) & (r[1:] == r[:-1])
