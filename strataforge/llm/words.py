"""Word and shingle hashes of whole Arrow batches of text, vectorised with numpy.

Words are maximal runs of bytes other than space and \\x09-\\x0D; these bytes never occur inside a
longer UTF-8 sequence, so the split is the same on bytes and on code points.

A word's hash sums a finalised 64-bit value for each byte and its place in the word (not a polynomial,
for which colliding strings are known) and finalises the sum. Among n different words or shingles two
share a hash by chance with a probability of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240521)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Some rows of a batch: row numbers, bytes, and the words' limits and hashes; words first[i]:first[i+1] are of row i."""

    rows: range
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    #: Bytes offset[i]:offset[i+1] are of row i.
    offset: np.ndarray


def slices(text: pa.Array, lower: bool) -> Iterator[Slice]:
    """The rows of a string array in slices of about SLICE_BYTES. A null text has no words."""
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield _slice(range(at, to), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def _slice(rows: range, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Slice:
    data = _LOWER[data] if lower else data
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:n]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    length = end - start
    last = np.cumsum(length)
    within = np.arange(last[-1] if len(last) else 0) - np.repeat(last - length, length)
    total = np.zeros(len(within) + 1, dtype=np.uint64)
    np.cumsum(mix(_BYTE[data[word]] + within.astype(np.uint64) * _P), out=total[1:], dtype=np.uint64)
    hashes = mix(total[last] - total[last - length] + length.astype(np.uint64))
    return Slice(rows, data, start, end, hashes, np.searchsorted(start, offsets), offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width consecutive words; rows of a slice are not told apart here."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * _Q + hashes[k : k + n]
    return mix(total + np.uint64(width))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's words; with fewer words, the whole sequence as one."""
    return np.unique(shingles(hashes, min(width, len(hashes)))) if len(hashes) else hashes
