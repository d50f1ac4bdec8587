"""Words of whole text columns as numpy arrays, inside Arrow tasks.

A word is ``[^\\x20\\x09-\\x0D]+``.  These six bytes never occur inside a UTF-8
sequence, so a column is cut on its bytes, all texts of a chunk at once.  A word is known
by 64 bits: each eight bytes of it are mixed with their place by a nonlinear bijection,
and these are added up.  (A polynomial modulo 2**64 would give equal hashes to long words
that repeat a Thue-Morse pattern, whatever its base.)  Windows of words are known by
running (Karp-Rabin) hashes of the mixed hashes of their words, from prefix sums modulo
2**64; windows have 50 words at most, too few for such a pattern to matter: two
different ones share a hash with a chance of about 2**-44 a pair in the worst arrangement
of words and 2**-60 and less otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_LANE_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown when needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def until(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_word_powers = _Powers(_WORD_BASE)


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span; equal contents, equal hash."""
    up, down = powers.until(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def code_spans_hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``codes[start:end]`` for every span of bytes or code points."""
    wide = codes.dtype.itemsize
    data = np.zeros(len(codes) * wide + 8, dtype=np.uint8)
    data[: len(codes) * wide] = np.ascontiguousarray(codes).view(np.uint8)
    # every eight bytes, from any byte on
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data.data, strides=(1,))
    sizes = (ends - starts) * wide
    lanes = -(-sizes // 8)
    place = ranges(np.zeros(len(lanes), dtype=np.int64), lanes)
    span = np.repeat(np.arange(len(lanes)), lanes)
    held = np.minimum(sizes[span] - 8 * place, 8).astype(np.uint64)
    values = eight[starts[span] * wide + 8 * place] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * held))
    # mixed twice, with the place in between, so that no pattern of bytes cancels out
    parts = mixed(mixed(values) + (place.astype(np.uint64) + np.uint64(1)) * _LANE_STEP)
    sums = np.zeros(len(parts) + 1, dtype=np.uint64)
    np.cumsum(parts, out=sums[1:])
    last = np.cumsum(lanes)
    return mixed(sums[last] - sums[last - lanes] + sizes.astype(np.uint64))


@dataclass
class Words:
    """The words of ``n_texts`` texts in order; spans are byte positions in ``data``."""

    n_texts: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    """Index of each word's text."""
    first: np.ndarray
    """Index of each text's first word, and at the end the number of words."""

    def hashes(self) -> np.ndarray:
        return code_spans_hashed(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    if data is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    return at - at[0], np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows, with their first index, of at most ``limit`` bytes (or one row)."""
    offsets, _ = utf8(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, column.slice(at, end - at)
        at = end


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """All words of a string column; ``lower`` maps A-Z to a-z first."""
    offsets, data = utf8(column)
    if lower:
        data = _LOWER[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(len(column), data, starts, ends, text, first)


def windows_hashed(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and hash of every run of ``size`` words within one text."""
    starts = np.arange(max(0, len(hashes) - size + 1))
    starts = starts[words.first[words.text[starts] + 1] - starts >= size]
    return starts, spans_hashed(hashes, starts, starts + size, _word_powers)


def spans_of_words(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word runs ``[start, end)``; agrees with ``windows_hashed``."""
    return spans_hashed(hashes, starts, ends, _word_powers)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start .. start + length - 1`` of every pair, one after another."""
    total = np.cumsum(lengths)
    offset = np.repeat(starts - np.concatenate([[0], total[:-1]]), lengths)
    return offset + np.arange(total[-1] if len(total) else 0)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
