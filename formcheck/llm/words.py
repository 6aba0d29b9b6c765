"""Words of a batch of texts as numpy arrays: positions and 64-bit hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hash, and the multipliers of the final mixing (public constants of splitmix64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps of each base.
KEPT = (1 << 20) + 1


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base."""
    known = _powers.get(base)
    if known is not None and n <= len(known):
        return known[:n]
    out = np.full(max(n, 1 << 16), base, np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if len(out) <= KEPT:
        _powers[base] = out
    return out[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]: polynomials, through sums over all values, brought to a common power
    at the end."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    size = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * powers(INVERSE, n + 1)[start] + size * np.uint64(0xD6E8FEB86659FD93))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 19, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: rows whose texts have at most `most` bytes together (a longer text is a part of its
    own), and at most `rows` rows."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
        stop = min(max(at + 1, fits), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return text, offsets - offsets[0]


class Words:
    """start, end (byte positions), row and, if asked for, hash of each word of a batch; first: number of
    words before each row. hashed: with A-Z lower-cased first."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, hashed: bool):
        n = len(text)
        space = SPACE[text]
        new = np.empty(n + 1, bool)
        new[:n], new[n] = ~space, False
        begin = new[:n].copy()
        begin[1:] &= space[:-1]
        at = offsets[:-1][offsets[:-1] < n]
        begin[at] = new[at]
        self.start = np.flatnonzero(begin)
        last = new[:n].copy()
        last[:-1] &= space[1:]
        at = offsets[1:-1]
        at = at[(at > 0) & (at < n)] - 1
        last[at] = new[at]
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        if not hashed:
            return
        text = np.where((text >= 65) & (text <= 90), text + 32, text)
        self.hash = span_hashes(text, self.start, self.end)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the `size`-word shingles of each row; a row with fewer words has its whole sequence."""
    h, n = words.hash, len(words.hash)
    counts = np.diff(words.first)
    rows, out = [], []
    if n >= size:
        mixed = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            mixed = mixed * np.uint64(0x9FB21C651E98DF25) + h[k : n - size + 1 + k]
        inside = words.row[: n - size + 1] == words.row[size - 1 :]
        rows.append(words.row[: n - size + 1][inside])
        out.append(mix(mixed[inside] + np.uint64(size)))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        mixed = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            mixed[has] = mixed[has] * np.uint64(0x9FB21C651E98DF25) + h[words.first[short[has]] + k]
        rows.append(short)
        out.append(mix(mixed + counts[short].astype(np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value), sorted by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
