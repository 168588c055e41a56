"""Vectorised words and hashes over Arrow string columns.

Every text operator of this subpackage that runs Python inside tasks needs
the same thing: the words of many texts, as 64-bit hashes, without a Python
loop per word. ``chunks`` walks an Arrow column in pieces of bounded bytes
(a single longer text is a piece of its own), lower-cases ASCII A-Z on the
raw UTF-8 bytes and returns word positions and word hashes as numpy arrays.

A word hash is a polynomial over the word's bytes modulo 2**64 followed by
a mixing step, so equal words have equal hashes in every task, Python
version and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1

# Byte classes. Words of the contracts are runs of bytes outside the class;
# every byte of a multi-byte UTF-8 character belongs to a word.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True  # after lower-casing

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n (kept between calls, grown by doubling)."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        inv = pow(_BASE, -1, 1 << 64)
        for name, base in (("_powers", _BASE), ("_inverse", inv)):
            table = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                while len(table) < size:
                    step = np.uint64(pow(base, len(table), 1 << 64))
                    table = np.concatenate([table, table[: size - len(table)] * step])
            globals()[name] = table
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


@dataclass
class Chunk:
    """Words of the rows ``first .. first + rows`` of a column."""

    first: int
    rows: int
    data: np.ndarray  # lower-cased bytes of the rows, one after the other
    ends: np.ndarray  # byte end of each row in data
    row: np.ndarray  # row (0-based in the chunk) of each word
    start: np.ndarray  # first byte of each word
    stop: np.ndarray  # byte after each word
    hash: np.ndarray  # uint64 hash of each word

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def spans(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of under 2**16 rows whose bytes stay under ``limit``; a longer row is alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n, i + 65_535)
        yield i, j
        i = j


def chunks(column: pa.Array, breaks: np.ndarray = BLANKS, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    raw, offs = text_buffers(column)
    for i, j in spans(offs, limit):
        data = _LOWER[raw[offs[i] : offs[j]]]
        ends = offs[i + 1 : j + 1] - offs[i]
        yield words_of(data, ends, i, breaks)


def words_of(data: np.ndarray, ends: np.ndarray, first: int = 0, breaks: np.ndarray = BLANKS) -> Chunk:
    n = len(data)
    rows = len(ends)
    starts_of_rows = np.concatenate([[0], ends[:-1]]) if rows else np.zeros(0, np.int64)
    inside = ~breaks[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = starts_of_rows[(starts_of_rows < n)]
    begin[edge] = inside[edge]  # a word does not run over the end of its text
    start = np.flatnonzero(begin)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    close = ends[ends > 0] - 1
    last[close] = inside[close]
    stop = np.flatnonzero(last) + 1
    row = np.searchsorted(ends, start, side="right")
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        h = mix((sums[stop] - sums[start]) * inverse[start])
    return Chunk(first, rows, data, ends, row, start, stop, h)


@dataclass
class Words:
    """Distinct words of a chunk."""

    hash: np.ndarray  # sorted
    inverse: np.ndarray  # distinct word of each word of the chunk
    count: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def distinct_words(chunk: Chunk) -> Words:
    h, first, inverse, count = np.unique(chunk.hash, return_index=True, return_inverse=True, return_counts=True)
    return Words(h, inverse.ravel(), count, chunk.start[first], chunk.stop[first])


def ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, owner) of the ranges start .. start + size, one after the other."""
    owner = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size), owner


def spelled(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lead: int = 0x20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words with a ``lead`` byte before and a blank after: (bytes, place in the word, owner)."""
    size = stop - start + 2
    place, owner = ragged(np.zeros(len(size), np.int64), size)
    out = np.where(place > 0, np.uint8(0x20), np.uint8(lead))
    inner = (place > 0) & (place < size[owner] - 1)
    out[inner] = data[(start[owner] + place - 1)[inner]]
    return out, place, owner


def packed_grams(data: np.ndarray, start: np.ndarray, stop: np.ndarray, order: int, lead: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """(gram, owner): for each byte of the words and their end, the last ``order`` bytes up to it.

    A gram starts at the byte before the word at the earliest, so it depends
    on the word alone; its lowest byte is the byte itself.
    """
    raw, place, owner = spelled(data, start, stop, lead)
    wide = raw.astype(np.uint64)
    out = wide.copy()
    for k in range(1, order):
        out[k:] |= np.where(place[k:] >= k, wide[:-k], np.uint64(0)) << np.uint64(8 * k)
    keep = place > 0
    return out[keep], owner[keep]


def running_grams(chunk: Chunk, order: int, end: int, lead: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """(gram, size): for each byte of the running texts, the last ``order`` bytes up to it, and how many bytes each text has.

    A text is a ``lead`` byte, its words with a blank after each, and the byte
    ``end``. Grams go on through the blanks into the words before; they start
    at the lead at the earliest. The lead has no gram of its own.
    """
    width = chunk.stop - chunk.start
    before = np.cumsum(width + 1) - (width + 1)
    begins = np.searchsorted(chunk.row, np.arange(chunk.rows + 1))  # first word of each text
    upto = np.append(before, before[-1] + width[-1] + 1 if len(width) else 0)[begins]
    size = np.diff(upto) + 2
    first = upto[:-1] + 2 * np.arange(chunk.rows)
    text = np.full(int(size.sum()), 0x20, np.uint8)
    text[first], text[first + size - 1] = lead, end
    at, owner = ragged(chunk.start, width)
    text[at + (before + 2 * chunk.row + 1 - chunk.start)[owner]] = chunk.data[at]
    wide = text.astype(np.uint64)
    out = wide.copy()
    for k in range(1, order):
        out[k:] |= wide[:-k] << np.uint64(8 * k)
    for k in range(min(order - 1, int(size.max()) if len(size) else 0)):  # nothing of the text before
        own = first[size > k] + k
        out[own] &= np.uint64((1 << (8 * (k + 1))) - 1)
    coded = np.ones(len(out), bool)
    coded[first] = False
    return out[coded], size - 1


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    """Values of ``wanted`` in sorted ``keys``; ``missing`` (a value or array) where absent."""
    if not len(keys):
        return np.broadcast_to(np.asarray(missing, values.dtype), wanted.shape).copy()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)
