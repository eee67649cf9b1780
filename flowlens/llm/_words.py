"""Vectorised word hashes of Arrow string columns: no Python object per word.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D. In UTF-8 those bytes never occur inside
another character, so byte work equals code point work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[SPACES] = 0
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
#: Factors of the words of a shingle by place, and of a whole short text.
PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_places: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """A random factor for each place in a word: the hash is universal, unlike powers of one number modulo 2^64."""
    if not _places or len(_places[0]) < n:
        size = max(2 * n, 1 << 10)
        _places[:] = [mix(np.arange(1, size + 1, dtype=np.uint64) * _P) | np.uint64(1)]
    return _places[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and the offsets of its rows in them; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about `most` bytes at most (one long row may have more)."""
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def word_hashes(column: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word and the end); fold: A-Z count as a-z."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] |= inside[edge]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    data, starts = data[starts[0] :], starts - starts[0]
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, spans)
    sums = np.add.reduceat((_FOLDED if fold else _BYTES)[data] * _factors(int(spans.max()))[place], starts)
    return mix(sums), counts


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Of one text: a hash of each run of n words; with fewer words (but one at least) of the whole sequence."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * PLACES[i]
    return mix(out + np.uint64(k))
