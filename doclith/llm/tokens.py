"""Words of whole Arrow batches as 64-bit hashes, by array operations over the batch's bytes.

Texts are never decoded or split into Python strings. A byte gets a random 64-bit number; a word's hash is the
polynomial of its bytes, taken from running sums, and then mixed. Everything is a fixed function of the bytes, the
same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # of text at once; a longer text is a chunk of its own
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTE = _stream(256, 1)
_ODD = _stream(64, 2) | U(1)
_BASE = int(_ODD[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_NO_LETTER = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Of a chunk: hash of each word, where each text's words start (one more at the end), and their byte spans."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows within each text, and the word at which each starts."""
        n = len(self.hashes)
        at = np.arange(max(0, n - k + 1))
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        at = at[text[: len(at)] == text[k - 1 :]] if len(at) else at
        total = np.zeros(len(at), U)
        for j in range(k):
            total += self.hashes[at + j] * _ODD[j + 1]
        return mix(total), at


def words(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]], A-Z lower-cased. Blanks part words; with ``letters`` all
    ASCII that is no letter or digit does, and capitals of Latin-1 are lower-cased too."""
    low = _LOWER[data]
    if letters and len(low):
        after = np.zeros(len(low), bool)
        after[1:] = data[:-1] == 0xC3
        low[after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
    part = (_NO_LETTER if letters else _BLANK)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    word = ~part
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = part[:-1]
    behind = np.empty(len(data), bool)
    behind[-1:] = True
    behind[:-1] = part[1:] | first[1:-1]
    starts = np.flatnonzero(word & (before | first[:-1]))
    ends = np.flatnonzero(word & behind) + 1
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[low] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, low, offsets)


def chunks(column: pa.Array, letters: bool = False) -> Iterator[tuple[int, int, Words]]:
    """First row, row behind the last, and Words, chunk by chunk; null texts are empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        upto = min(upto, len(column))
        yield at, upto, words(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at], letters)
        at = upto


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One list of int64 a text: values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(U).view(np.int64)))
