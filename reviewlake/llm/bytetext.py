"""Words, lines and byte counts of many texts at once, in numpy.

An Arrow string column is one buffer of UTF-8 bytes with offsets. The helpers
here work on that buffer in pieces of a few MB, so memory stays bounded however
many rows a batch has; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# A piece ends after the text that takes it over so many bytes.
PIECE_BYTES = 1 << 20
# An odd multiplier, so it has an inverse modulo 2**64.
_RADIX = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def separators(text: str) -> np.ndarray:
    """Which of the 256 byte values separate words; ``text`` lists them."""
    table = np.zeros(256, bool)
    table[list(text.encode("latin-1"))] = True
    return table


WHITE = separators("\t\n\x0b\x0c\r ")
# Whatever ASCII is neither a letter nor a digit.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bytes, offsets)`` of consecutive texts; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of the maximal runs of other bytes; no run spans two texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A text starts a new word even where the text before it ends in one.
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside[:-1] & (~inside[1:] | begins[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_RADIX, -1, 1 << 64)
    up, down = np.full(size, _RADIX, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    return values * np.uint64(0x94D049BB133111EB)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running sum over the buffer."""
    size = 1 << max(int(len(data)).bit_length(), 10)
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of every run of ``n`` words inside one text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_RADIX) + hashes[k : k + count])
    first = np.flatnonzero(rows[:count] == rows[n - 1 : n - 1 + count])
    return first, out[first]


def text_hash(text: str) -> int:
    """The hash :func:`span_hashes` gives a span with these bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0]) & _WRAP
