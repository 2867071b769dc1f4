"""Vectorised words of Arrow text batches.

A word is a run of bytes outside ``0x20`` and ``0x09``-``0x0D``. UTF-8 continuation bytes never fall in that
range, so the byte view is exact. Words are compared by 64-bit keys: a polynomial in the bytes modulo 2**64, mixed
with the length and finalised. Two different words of a corpus share a key with a chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# An odd base, its inverse modulo 2**64, and the finaliser of a well-known 64-bit mixer.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

SLICE_BYTES = 1 << 19

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

#: Everything but ASCII letters, digits and bytes of longer characters: for terms without their punctuation.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POWERS: dict[int, np.ndarray] = {}
_KEPT: list[dict] = [_POWERS]


def kept(cache: dict) -> dict:
    """Registers what an operator keeps in a worker from task to task."""
    _KEPT.append(cache)
    return cache


def release() -> None:
    """Empties all of it: workers are used again by other operators, which need the memory."""
    for cache in _KEPT:
        cache.clear()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept until ``release``."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: the next run is the known run times base**done
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 2 * SLICE_BYTES:  # a longer text's powers go with its slice
            _POWERS[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(33)
    return x


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial key of ``values[start:end]`` for each span, the same wherever the span lies."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (total[ends] - total[starts]) * inverse[starts]


class Words:
    """Words of consecutive texts: keys, byte spans in ``data`` and the first word of every text."""

    __slots__ = ("data", "starts", "ends", "keys", "first")

    def __init__(self, data: np.ndarray, text_ends: np.ndarray, lower: bool, gaps: np.ndarray = SPACES):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        gap = gaps[data]
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~gap
        starts_mask = (inside[1:-1] == 1) & (inside[:-2] == 0)
        ends_mask = (inside[1:-1] == 1) & (inside[2:] == 0)
        # Texts touch each other in the buffer: a text's first byte opens a word, its last one closes it.
        opens = np.concatenate([[0], text_ends[:-1]])
        full = text_ends > opens
        at = opens[full]
        starts_mask[at] = inside[1:-1][at] == 1
        at = text_ends[full] - 1
        ends_mask[at] = inside[1:-1][at] == 1
        self.starts = np.flatnonzero(starts_mask)
        self.ends = np.flatnonzero(ends_mask) + 1
        sums = span_sums(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends)
        self.keys = mix64(sums + (self.ends - self.starts).astype(np.uint64) * np.uint64(MIX[1]))
        self.first = np.searchsorted(self.starts, np.concatenate([[0], text_ends]), side="left")

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def __len__(self) -> int:
        return len(self.starts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column (null as empty) and the end of every text in them."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column), dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds[1:] - bounds[0]


def sliced_words(column: pa.Array, lower: bool, slice_bytes: int = SLICE_BYTES, gaps: np.ndarray = SPACES) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) over slices of about ``slice_bytes``; a longer text is a slice of its own.

    Every text is read whole; slices only bound the memory of the arrays made from it.
    """
    raw, ends = text_buffer(column)
    row, n = 0, len(ends)
    while row < n:
        begin = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, begin + slice_bytes, side="right")))
        yield row, stop, Words(raw[begin : int(ends[stop - 1])], ends[row:stop] - begin, lower, gaps)
        row = stop


def signed(keys: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return keys.view(np.int64)


def window_keys(keys: np.ndarray, first: np.ndarray, width: int, base: int = MIX[0]) -> tuple[np.ndarray, np.ndarray]:
    """Key of every run of ``width`` words inside one text, and the word each run starts at."""
    n = len(keys)
    if n < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    starts = np.arange(n - width + 1)
    text = np.searchsorted(first, starts, side="right") - 1
    starts = starts[starts + width <= first[text + 1]]
    return mix64(span_sums(keys, starts, starts + width, base)), starts
