"""Words and shingles of many texts at once, as 64-bit hashes in NumPy arrays.

The bytes of a batch of texts lie in one buffer. A prefix sum of byte * BASE^position (mod 2^64) gives the polynomial hash of any
stretch of bytes as a difference of two entries, shifted back by a power of BASE's inverse, so no word is ever made a Python object.
Hashes are mixed, so that their bits are even. Equal words have equal hashes in any batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n, kept for the next call."""
    if len(_powers.get("up", ())) <= n:
        m = max(n + 1, CHUNK + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Words:
    """The words of some texts: hash, the bytes [start, end) in data, the text each is of (doc), and where a text's words begin (first, one entry more than texts)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.bounds, n = data, bounds, len(data)
        up, down = _power(n)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True  # a word never runs on into the next text
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start] + length * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))


_FACTORS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words and where each text's begin (one entry more than texts). A text with fewer words has its whole sequence as one; one without words has none."""
    h, first = words.hash, words.first
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    full = np.repeat(n >= k, count)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        real = full | (at + j < np.repeat(first[1:], count))
        out += np.where(real, h[np.minimum(at + j, len(h) - 1)] * _FACTORS[j], np.uint64(0)) if len(h) else 0
    return mixed(out + np.where(full, np.uint64(0), np.uint64(k))), begin


def text_chunks(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, bounds) of stretches of a string column of about chunk bytes; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
