"""Hashes of words and word windows of whole texts, computed over batches in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240607)
#: A random number per byte, an odd base and its inverse modulo two to the 64.
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FACTORS = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))

#: Bytes hashed at a time; longer texts go on in the next stretch.
STRETCH = 1 << 18

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, factor, np.uint64))]).astype(np.uint64)
                for factor in (_BASE, _INVERSE)
            )
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit number spread over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _stretches(data: bytes) -> Iterator[tuple[int, int]]:
    """Parts of about STRETCH bytes that end in front of white space."""
    start = 0
    white = b" \n\t\r\x0b\x0c"
    while start < len(data):
        end = start + STRETCH
        if end < len(data):
            while end < len(data) and data[end] not in white:
                end += 1
        else:
            end = len(data)
        yield start, end
        start = end


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of ``data``; words are parted by the six ASCII white-space characters."""
    hashes, starts, ends = [], [], []
    for start, end in _stretches(data):
        part = np.frombuffer(data, np.uint8, end - start, start)
        bounds = np.flatnonzero(np.diff(np.concatenate([[True], _IS_WHITE[part], [True]])))
        first, last = bounds[::2], bounds[1::2]
        power, inverse = _tables(len(part))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * power[: len(part)], dtype=np.uint64)])
            own = (sums[last] - sums[first]) * inverse[first]
        hashes.append(mix(own + (last - first).astype(np.uint64)))
        starts.append(first + start)
        ends.append(last + start)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and where those of each text begin (one more entry for the end)."""
    hashes, starts, _ = words(b"\n".join(texts))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on, for every place that has as many after it."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if k <= 8:
            total = np.zeros(n, np.uint64)
            for j in range(k):
                total += hashes[j : j + n] * _FACTORS[j]
        else:
            power, inverse = _tables(len(hashes))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)])
            total = (sums[k:] - sums[:-k]) * inverse[:n]
    return mix(total + np.uint64(k))
