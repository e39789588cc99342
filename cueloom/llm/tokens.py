"""Words and word shingles of Arrow batches as arrays of 64-bit hashes, computed by whole-array steps inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, long enough for any chunk seen so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 4096)
            steps = np.full(n, _ODD, _U)
            steps[0] = 1
            back = np.full(n, pow(_ODD, -1, 2**64), _U)
            back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)
        return self.up, self.down


POWERS = Powers()


def span_hash(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[b:e]`` for every span, independent of where the span lies."""
    up, down = POWERS.to(len(values) + 1)
    total = np.empty(len(values) + 1, _U)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(_U))


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows) of runs of whole texts, null texts as empty ones."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_ODD))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space, and of words of letters and digits (all bytes of other scripts count as such).
PLAIN = ~BLANKS
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
VALUES = _values()


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered, and the accented capitals of Latin-1 in UTF-8 as well."""
    low = LOWER[data]
    if len(low) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[second] += 0x20
    return low


def words(low: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, begin, end) of the words of lowered bytes; a word lies within its row."""
    if not len(low):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none
    inside = kept[low]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(low))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets, begins, "right") - 1
    return span_hash(VALUES[low], begins, ends), rows, begins, ends


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of all runs of n words within a row."""
    if len(hashes) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    total = hashes[:last].copy()
    for k in range(1, n):
        total = total * _U(_ODD) + hashes[k : k + last]
    at = np.flatnonzero(rows[:last] == rows[n - 1 :])
    return mix(total[at]), at


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-word shingles of every row, sorted by row; a row of fewer words has its whole sequence as one."""
    grams, at = shingles(hashes, rows, n)
    owner = rows[at]
    counts = np.bincount(rows, minlength=1)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(rows, short)
        whole = span_hash(hashes, first, first + counts[short]) ^ _U(0x5851F42D4C957F2D)
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]
