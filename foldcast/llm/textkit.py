"""Vectorised text helpers for Arrow batches: word bounds, word hashes, shingle hashes.

All hashes are 64-bit. A word's hash is a polynomial over a fixed random byte table, taken
from prefix sums, so a whole batch of texts is hashed by a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Odd multipliers by the place of a word within its shingle.
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text that are hashed together.
CHUNK = 1 << 18


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_STEP, _STEP_INV))
        return self.up, self.down


_POWERS = _Powers()


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums S with which :func:`span_hash` gives the hash of any span of ``codes`` (uint64)."""
    up, _ = _POWERS.to(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _POWERS.to(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts end to end, and each text's bounds (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, (bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64))


def chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK`` bytes; a longer text stands alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
        yield at, to
        at = to


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lower-cased word hashes by runs of texts: (first row, hashes, words' bounds by text)."""
    raw, bounds = text_bytes(column)
    for at, to in chunks(bounds):
        part = LOWER[raw[bounds[at] : bounds[to]]]
        own = bounds[at : to + 1] - bounds[at]
        start, end = word_bounds(part, own)
        sums = prefix_hash(BYTE_CODES[part])
        yield at, span_hash(sums, start, end), np.searchsorted(start, own)


def word_bounds(part: np.ndarray, own: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of the texts with bounds ``own`` in the bytes ``part``; ``gap`` marks the bytes between."""
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~gap[part]
    first = np.empty(len(part), dtype=bool)
    first[0], first[1:] = True, ~solid[:-1]
    inner = own[own < len(part)]
    first[inner] = True
    start = np.flatnonzero(first & solid)
    last = np.empty(len(part), dtype=bool)
    last[-1], last[:-1] = True, ~solid[1:]
    last[inner[inner > 0] - 1] = True
    return start, np.flatnonzero(last & solid) + 1


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of fewer words, of the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    with np.errstate(over="ignore"):
        out = words[: n - k + 1] * _PLACES[0]
        for j in range(1, k):
            out = out + words[j : n - k + 1 + j] * _PLACES[j]
    return mix(out, k)
