"""Vectorised word and shingle hashing over Arrow string columns (runs in Python workers).

All functions work on UTF-8 bytes. ASCII white space never occurs inside a multi-byte character, so cutting words on
bytes is cutting them on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time; a longer text is walked in blocks that end at white space.
BLOCK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit value for each byte, so that the polynomial's inputs have no structure.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b))]), dtype=np.uint64) for b in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes of text (a longer text alone), with bytes and offsets."""
    data, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, min(n, int(np.searchsorted(at, at[row] + limit, "right")) - 1))
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; row boundaries end words too."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] |= inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the ordered, disjoint byte spans."""
    out = np.empty(len(start), np.uint64)
    row = 0
    while row < len(start):
        stop = max(int(np.searchsorted(end, start[row] + BLOCK, "right")), row + 1)
        lo, hi = int(start[row]), int(end[stop - 1])
        power, inverse = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE[data[lo:hi]] * power[:-1], dtype=np.uint64, out=total[1:])
        s, e = start[row:stop] - lo, end[row:stop] - lo
        out[row:stop] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0x2545F4914F6CDD1D))
        row = stop
    return out


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every word, and for each row the number of its first word (with the total at the end)."""
    start, end = word_spans(data, at)
    return span_hashes(LOWER[data] if lower else data, start, end), start, end, np.searchsorted(start, at, "left")


#: One multiplier for each place in a shingle.
_PLACES = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | U(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; len(words) - k + 1 values, none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _PLACES[i]
    return mix(total)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of every row, sorted, end to end, and their offsets by row.

    A row of fewer than k words has its whole word sequence as its only shingle; a row without words has none.
    """
    words, _, _, first = word_hashes(data, at, lower)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    all_of = shingle_hashes(words, k)
    ok = row[: len(all_of)] == row[k - 1 :][: len(all_of)] if len(all_of) else np.zeros(0, bool)
    values, owner = all_of[ok], row[: len(all_of)][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] += words[first[short[has]] + i] * _PLACES[i]
        extra = mix(extra + count[short].astype(np.uint64) * U(0xA0761D6478BD642F))
        where = np.searchsorted(owner, short)
        values, owner = np.insert(values, where, extra), np.insert(owner, where, short)
    edges = np.searchsorted(owner, np.arange(len(count) + 1), "left")
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        values[lo:hi].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(count) + 1), "left")
