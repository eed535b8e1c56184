"""Vectorised tokenising and hashing of UTF-8 text that arrives in Arrow batches.

Words are maximal runs of bytes outside a separator class. All classes used here are ASCII, so a
UTF-8 character is never cut. A word's hash is a polynomial over random 64-bit byte codes, mixed by
a finaliser; A-Z may be folded to a-z by giving both the same code. Bytes are worked through in blocks,
so a long text takes what its words do (24 bytes each), not the work arrays of all its bytes at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
#: Bytes that are split and hashed at once.
BLOCK_BYTES = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

#: Everything but letters: ASCII letters and all bytes of multi-byte characters count as letters.
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[np.r_[65:91, 97:123, 128:256]] = False

_rng = np.random.Generator(np.random.PCG64(20240229))
EXACT_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_CODES = EXACT_CODES.copy()
FOLDED_CODES[65:91] = EXACT_CODES[97:123]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(64, _BASE, np.uint64))
_WINDOW = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the base, from the first on."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * _POWERS[-1]])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; null rows are empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes (one row at least), with their bytes and relative offsets."""
    data, at = column_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


@dataclass
class Words:
    """Words of some rows: byte ranges, hashes, and for each row its range of words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    data: np.ndarray | None = None
    codes: np.ndarray | None = None

    def prefix_hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``length`` bytes of all words that are longer, and those words' indexes."""
        longer = np.flatnonzero(self.ends - self.starts > length)
        at, powers = self.starts[longer], _powers(length)
        total = np.zeros(len(longer), np.uint64)
        for j in range(length):
            total += self.codes[self.data[at + j]] * powers[j]
        return mix(total ^ np.uint64(length * 0x9E3779B1)), longer


def _long_word(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of one word of many bytes, added up in blocks."""
    powers, scale, total = _powers(BLOCK_BYTES)[:BLOCK_BYTES], np.ones(1, np.uint64), np.zeros(1, np.uint64)
    for lo in range(0, len(data), BLOCK_BYTES):
        part = data[lo : lo + BLOCK_BYTES]
        total += (codes[part] * powers[: len(part)]).sum(dtype=np.uint64) * scale
        scale = scale * powers[-1]
    return mix(total ^ np.uint64(len(data)))


def _split(data: np.ndarray, edges: np.ndarray, separators: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one block; words also end at ``edges``."""
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    if len(starts) == 1 and ends[0] - starts[0] > BLOCK_BYTES:
        return starts, ends, _long_word(data[starts[0] : ends[0]], codes)
    lengths = ends - starts
    powers = _powers(int(lengths.max()))
    where = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    position = np.arange(len(where)) - np.repeat(first, lengths)
    terms = codes[data[where]] * powers[position]
    return starts, ends, mix(np.add.reduceat(terms, first) ^ lengths.astype(np.uint64))


def _cuts(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK_BYTES that cut no word: each ends at a separator or a row's edge."""
    lo, n = 0, len(data)
    while n - lo > BLOCK_BYTES:
        hi = lo + BLOCK_BYTES
        row = int(at[np.searchsorted(at, hi, side="right") - 1])
        gap = np.flatnonzero(separators[data[lo:hi]])
        end = max(row, lo + int(gap[-1]) + 1 if len(gap) else lo)
        while end <= lo:
            # One word fills the block: it goes on to the next separator or the row's end.
            row = int(at[min(np.searchsorted(at, hi, side="left"), len(at) - 1)])
            gap = np.flatnonzero(separators[data[hi : hi + BLOCK_BYTES]])
            end = min(row if row <= hi + BLOCK_BYTES else n, hi + int(gap[0]) if len(gap) else n)
            if end == n and hi + BLOCK_BYTES < n:
                hi, end = hi + BLOCK_BYTES, lo
        yield lo, end
        lo = end
    if n > lo:
        yield lo, n


def words(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES, codes: np.ndarray = EXACT_CODES, running: bool = False) -> Words:
    """Splits rows, given as bytes and offsets, into hashed words; ``running`` keeps what prefix_hashes needs."""
    found = []
    for lo, hi in _cuts(data, at, separators):
        edges = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        starts, ends, hashes = _split(data[lo:hi], edges, separators, codes)
        found.append((starts + lo, ends + lo, hashes))
    if len(found) == 1:
        starts, ends, hashes = found[0]
    elif found:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        starts, ends, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows = np.searchsorted(starts, at)
    return Words(starts, ends, hashes, rows, data if running else None, codes if running else None)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (one fewer entry per word of the run than words)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _WINDOW + hashes[j : j + n]
    return mix(total)


def shingle_sets(tokens: Words, size: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes; a row of fewer words has its sequence as one."""
    every = window_hashes(tokens.hashes, size)
    for lo, hi in zip(tokens.rows[:-1], tokens.rows[1:], strict=True):
        if hi - lo >= size:
            yield np.unique(every[lo : hi - size + 1])
        elif hi > lo:
            yield window_hashes(tokens.hashes[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def set_of(text: str | None, size: int) -> np.ndarray:
    """The shingle set of one text, A-Z folded."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return next(shingle_sets(words(data, np.array([0, len(data)]), codes=FOLDED_CODES), size))
