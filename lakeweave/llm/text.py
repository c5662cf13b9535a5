"""Vectorised text primitives shared by the operators: words and hashes straight from Arrow string buffers.

Texts never become Python strings here. A batch is cut into slices of about a megabyte (a longer text is a slice of
its own), so that the numpy arrays beside a slice stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits, so that any bits of a hash can serve as a bucket or as an order."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers = {"n": 0, "up": np.ones(0, U64), "down": np.ones(0, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    if _powers["n"] < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for key, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def byte_codes(fold: bool) -> np.ndarray:
    """A 64-bit code for each byte; with fold, A-Z share the codes of a-z."""
    values = np.arange(256, dtype=U64)
    if fold:
        values[65:91] += U64(32)
    return mix(values + U64(0x1234567))


FOLDED = byte_codes(True)

WHITE = np.zeros(256, bool)  # separators of the words [^\x20\x09-\x0D]+
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.ones(256, bool)  # separators of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and row offsets of a string column; a null is as an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """The words of a slice: byte ranges within the slice, the row of each, its hash, and word ranges by row."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first[r]:first[r + 1] are the words of row r


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, hashed: bool = True) -> Words:
    """Words of the rows that offsets bound within data; A-Z count as a-z."""
    begin = offsets[:-1] - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U64), np.zeros(len(begin) + 1, np.int64))
    gap = separators[data]
    edge = begin[begin < n]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[edge[edge > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    row = np.searchsorted(begin, starts, "right") - 1
    first = np.searchsorted(row, np.arange(len(begin) + 1))
    hashes = np.zeros(0, U64)
    if hashed:
        up, down = powers(n)
        total = np.zeros(n + 1, U64)
        np.cumsum(FOLDED[data] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    return Words(starts, ends, row, hashes, first)


def word_hashes(text: str, separators: np.ndarray) -> np.ndarray:
    """The hashes of one text's words, as words_of gives them."""
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)], np.int64), separators).hashes


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of fewer words, one of the whole sequence."""
    h, n = words.hashes, len(words.hashes)
    rolled = np.zeros(max(0, n - k + 1), U64)
    factor = 1
    for i in range(k if len(rolled) else 0):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        rolled += h[i : n - k + 1 + i] * U64(factor)
    rolled = mix(rolled)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            value = b - a
            for x in h[a:b].tolist():
                value = (value * 0xD6E8FEB86659FD93 + x) % (1 << 64)
            yield mix(np.array([value ^ 0x5BF03635], U64))
        else:
            yield np.zeros(0, U64)
