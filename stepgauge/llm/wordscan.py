"""Vectorised word scanning over Arrow string columns.

A word is a run of ASCII digits, ASCII letters (A-Z count as a-z) and non-ASCII
characters, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
On UTF-8 that is a run of bytes of one class, so no text is decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at in one go; bounds a worker's memory.
CHUNK_BYTES = 4_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows, of about ``most`` bytes and at most ``rows`` rows; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n, at + (rows or n))
        yield at, to
        at = to


class Words:
    """The words of some rows: ``hash`` (64 bits), ``doc`` (row), ``begin`` (n + 1 word offsets of rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        self.start, self.end, self.doc = runs(IS_WORD[self.low], offsets)
        self.hash = span_hashes(self.low, self.start, self.end)
        self.n = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true bytes that lies within a row."""
    if not inside.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.zeros(inside.size + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not start.size:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    out = mix((lanes[start] & _MASK[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    at, rest = 8, np.flatnonzero(size > 8)
    while rest.size and at < 64:
        lane = lanes[start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]
        out[rest] = mix(out[rest] ^ lane)
        at += 8
        rest = rest[size[rest] > at]
    for i in rest:  # words of over 64 bytes are few
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def scanned(column: pa.Array, most: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of the column, chunk by chunk."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets, most, rows):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
