"""Words of whole Arrow batches as numbers: where each starts and ends, and a 64-bit name for it.

Texts stay UTF-8; ASCII white space never occurs inside a longer character, so bytes can be split as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes (a longer text is a slice of its own), which bounds memory.
SLICE_BYTES = 4 << 20
#: Words beyond this many bytes are named by a library hash.
LONG_WORD = 1024

_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: The same, with ASCII punctuation counted as white space.
_IN_PLAIN_WORD = _IN_WORD.copy()
_IN_PLAIN_WORD[[c for c in range(128) if not chr(c).isalnum()]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def u64(x: int) -> np.uint64:
    return np.uint64(x & (2**64 - 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u64(27))) * u64(0x94D049BB133111EB)
    return x ^ (x >> u64(31))


def lower_case(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return _LOWER[data]


class Words:
    """Runs of the bytes that ``inside`` marks, or of what is not white space.

    ``starts``, ``ends``: byte positions in ``data``. ``names``: 64-bit names. Words of text t: first[t] to first[t + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False, inside: np.ndarray | None = None):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        if inside is None:
            inside = (_IN_PLAIN_WORD if plain else _IN_WORD)[data]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edge] = inside[edge]
        finishes[edge - 1] = inside[edge - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.names = self._names()

    def _names(self) -> np.ndarray:
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        blocks = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        out = mix(size.astype(np.uint64) + u64(0x9E3779B97F4A7C15))
        todo, k = np.flatnonzero(size <= LONG_WORD), 0
        while todo.size:
            left = size[todo] - k
            block = blocks[self.starts[todo] + k] & _KEEP[np.minimum(left, 8)]
            out[todo] = mix(out[todo] * u64(0x9E3779B97F4A7C15) + mix(block + u64(k)))
            todo, k = todo[left > 8], k + 8
        for w in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(self.data[self.starts[w] : self.ends[w]].tobytes(), digest_size=8).digest()
            out[w] = np.frombuffer(digest, "<u8")[0]
        return out

    def grams(self, n: int) -> np.ndarray:
        """Name of the ``n`` words from each word on, whatever text they are in; see ``whole``."""
        return sequences(self.names, n)

    def whole(self, n: int) -> np.ndarray:
        """For each of ``grams(n)``: whether it lies in one text."""
        count = max(0, len(self.names) - n + 1)
        limit = np.repeat(self.first[1:], self.counts)[:count]
        return np.arange(count) + n <= limit


def sequences(names: np.ndarray, n: int) -> np.ndarray:
    """Name of the ``n`` consecutive names from each position on."""
    count = max(0, len(names) - n + 1)
    out = np.full(count, u64(n))
    for k in range(n):
        out = out * u64(0xD6E8FEB86659FD93) + names[k : k + count]
    return mix(out)


def one_sequence(names: np.ndarray) -> np.uint64:
    return sequences(names, len(names))[0]


def shingles(w: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each text, its distinct ``n``-word shingles in ascending order; fewer words are one shingle, no words none."""
    grams = w.grams(n)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield np.array([one_sequence(w.names[a:b])], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch a few megabytes of text at a time: (rows, UTF-8 bytes, offsets). A null text is empty."""
    column = batch.column(text).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
