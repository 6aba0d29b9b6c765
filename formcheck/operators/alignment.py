"""Alignment of two page sequences, by any similarity or by thumbnails of their rasters.

A match costs twice the dissimilarity, a deletion or insertion one. The cheapest alignment is found by diagonals of the
cost matrix, a vector operation each, within a band about the main diagonal: a path that leaves a band of width w costs
more than w, so a band in which the cheapest path costs no more holds every cheapest path; else it is doubled. Similar
documents need narrow bands, and only the similarities inside a band are ever computed. Memory is one byte for each
cell of the band: at most (n + m) * (n + m + 1), for two copies of 2,000 pages that differ in ten 0.1 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Likeness of pages i and j (arrays of numbers from 0).
Likeness = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Size of a thumbnail (columns, rows), and the luma difference from which on a pixel has changed.
THUMBNAIL, CHANGED = (150, 210), 25
MATCH, DELETE, INSERT = 0, 1, 2
#: Thumbnails made or compared at a time.
AT_ONCE = 64
#: Pairs that are aligned at a time, and cells (pages x different words) of a pair whose overlaps are taken all at once.
ROWS, CELLS = 256, 1 << 22
#: First width of the band beyond the difference of the page counts.
SLACK = 8
SCHEMA = "row_no int, op string, expected_page int, actual_page int"


def _band(n: int, m: int, likeness: Likeness, limit: int) -> tuple[float, np.ndarray, int]:
    """(cost, moves, low): the cheapest path in the band of paths that may cost `limit`; moves[i + j, j - i - low]."""
    slack = (limit - abs(m - n)) // 2
    low, high = max(-n, min(0, m - n) - slack), min(m, max(0, m - n) + slack)
    # cost[k - low + 1]: of the last cell met on the line j - i = k; both parities of diagonals share the array.
    cost = np.full(high - low + 3, np.inf)
    cost[1 - low] = 0.0
    moves = np.full((n + m + 1, high - low + 1), INSERT, np.uint8)
    for d in range(1, n + m + 1):
        first = max(low, -d, d - 2 * n)
        k = np.arange(first + (first - d) % 2, min(high, d, 2 * m - d) + 1, 2)
        i, j, at = (d - k) // 2, (d + k) // 2, k - low + 1
        both = (i > 0) & (j > 0)
        match = np.full(len(k), np.inf)
        inside = both & np.isfinite(cost[at])
        match[inside] = cost[at][inside] + 2 * (1 - likeness(i[inside] - 1, j[inside] - 1))
        delete, insert = np.where(i > 0, cost[at + 1] + 1, np.inf), np.where(j > 0, cost[at - 1] + 1, np.inf)
        best = np.minimum(np.minimum(match, delete), insert)
        with np.errstate(invalid="ignore"):
            # Ties, and what is one but for rounding, go to match, then to deletion.
            moves[d, at - 1] = np.where(best - match > -1e-9, MATCH, np.where(best - delete > -1e-9, DELETE, INSERT))
        cost[at] = best
    return float(cost[m - n - low + 1]), moves, low


def align(n: int, m: int, likeness: Likeness | np.ndarray) -> list[tuple[str, int | None, int | None]]:
    """Cheapest alignment of n expected and m actual pages: (op, expected or None, actual or None), from 0. On the way back
    ties go to match, then deletion."""
    if isinstance(likeness, np.ndarray):
        matrix = likeness
        likeness = lambda i, j: matrix[i, j]
    limit = abs(n - m) + SLACK
    while True:
        cost, moves, low = _band(n, m, likeness, limit)
        if cost <= limit or limit >= n + m:
            break
        limit = min(2 * limit, n + m)
    steps, i, j = [], n, m
    while i or j:
        move = moves[i + j, j - i - low]
        if move == MATCH:
            i, j = i - 1, j - 1
            steps.append(("matched", i, j))
        elif move == DELETE:
            i -= 1
            steps.append(("deleted", i, None))
        else:
            j -= 1
            steps.append(("inserted", None, j))
    return steps[::-1]


def _frame(pair, steps: list[tuple[str, int | None, int | None]]) -> pd.DataFrame:
    page = lambda k: pd.array([None if s[k] is None else s[k] + 1 for s in steps], "Int32")
    return pd.DataFrame({"pair_id": pair, "row_no": range(1, len(steps) + 1), "op": [s[0] for s in steps], "expected_page": page(1), "actual_page": page(2)})


EMPTY = pd.DataFrame({"pair_id": [], "row_no": [], "op": [], "expected_page": [], "actual_page": []})


def _one_to_one(counts: DataFrame) -> DataFrame:
    equal = counts.where("n_expected = n_actual AND n_expected > 0").select("pair_id", F.explode(F.sequence(F.lit(1), F.col("n_expected").cast("int"))).alias("row_no"))
    return equal.select("pair_id", "row_no", F.lit("matched").alias("op"), F.col("row_no").alias("expected_page"), F.col("row_no").alias("actual_page"))


def _rows(pairs: pa.Array, aligned: list[list[tuple[str, int | None, int | None]]]) -> pa.RecordBatch:
    """Rows of the alignments of some pairs, pages from 1."""
    sizes = [len(steps) for steps in aligned]
    steps = [s for own in aligned for s in own]
    page = lambda k: pa.array([None if s[k] is None else s[k] + 1 for s in steps], pa.int32())
    numbers = np.concatenate([np.zeros(0, np.int32), *(np.arange(1, n + 1, dtype=np.int32) for n in sizes)])
    columns = [pairs.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(numbers, pa.int32()), pa.array([s[0] for s in steps], pa.string()), page(1), page(2)]
    return pa.RecordBatch.from_arrays(columns, ["pair_id", "row_no", "op", "expected_page", "actual_page"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, ROWS):
        yield batch.slice(k, ROWS)


def one_to_one(n: int) -> list[tuple[str, int, int]]:
    return [("matched", k, k) for k in range(n)]


def align_pages(counts: DataFrame, similarity: DataFrame) -> DataFrame:
    """counts(pair_id, n_expected, n_actual) and similarity(pair_id, expected_page, actual_page, similarity), pages
    from 1: (pair_id, row_no, op, expected_page, actual_page). Pairs of pages without a row have similarity 0. Equal page
    counts align one to one. A pair is one row with its similarities, so a batch holds many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            out, listed = [], batch.column("listed")
            starts, items = listed.offsets.to_numpy(), listed.values
            i, j, s = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for row, (n, m) in enumerate(zip(batch.column("n_expected").to_pylist(), batch.column("n_actual").to_pylist(), strict=True)):
                if n == m:
                    out.append(one_to_one(n))
                    continue
                own = slice(starts[row], starts[row + 1])
                out.append(align(n, m, _listed(i[own].astype(np.int64) - 1, j[own].astype(np.int64) - 1, s[own].astype(float), n, m)))
            yield _rows(batch.column("pair_id"), out)

    kind = counts.schema["pair_id"].dataType.simpleString()
    # Renamed, as both sides may stem from one table.
    pairs = similarity.groupBy(F.col("pair_id").alias("pair")).agg(F.collect_list(F.struct("expected_page", "actual_page", "similarity")).alias("listed"))
    rows = counts.select("pair_id", "n_expected", "n_actual").join(pairs, F.col("pair_id") == F.col("pair"), "left")
    listed = F.when((F.col("n_expected") != F.col("n_actual")) & F.col("listed").isNotNull(), F.col("listed")).otherwise(F.array().cast(pairs.schema["listed"].dataType))
    return rows.select("pair_id", "n_expected", "n_actual", listed.alias("listed")).mapInArrow(run, f"pair_id {kind}, {SCHEMA}")


def _listed(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: int, m: int) -> Likeness:
    """Likeness by listed cells; the others have none."""
    key = i * m + j
    order = np.argsort(key)
    key, value = np.append(key[order], n * m), np.append(s[order], 0.0)

    def likeness(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = np.searchsorted(key, i * m + j)
        return np.where(key[at] == i * m + j, value[at], 0.0)

    return likeness


def _overlap(sides: list[list[np.ndarray]]) -> Likeness:
    """Likeness by the words of pages, given as numbers: each different word of a page once."""
    whole = np.concatenate([np.zeros(0, np.int64), *sides[0], *sides[1]])
    vocabulary, codes = np.unique(whole, return_inverse=True)
    ends = np.cumsum([len(w) for side in sides for w in side])
    parts = np.split(codes, ends[:-1]) if len(ends) else []
    numbers = parts[: len(sides[0])], parts[len(sides[0]) :]
    sizes = [np.array([len(w) for w in side], np.int64) for side in sides]
    if (len(sides[0]) + len(sides[1])) * len(vocabulary) <= CELLS:
        held = [np.zeros((len(side), len(vocabulary)), np.float32) for side in sides]
        for rows, side in zip(held, numbers, strict=True):
            for k, w in enumerate(side):
                rows[k, w] = 1
        # Sums of ones below 2^24 are exact.
        same = (held[0] @ held[1].T).astype(np.int64)
        table = same / np.maximum(1, sizes[0][:, None] + sizes[1][None, :] - same)
        return lambda i, j: table[i, j]
    seen = np.zeros(len(vocabulary), bool)

    def likeness(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = numbers[0][x], numbers[1][y]
            seen[a] = True
            same = int(seen[b].sum())
            seen[a] = False
            out[k] = same / max(1, len(a) + len(b) - same)
        return out

    return likeness


def align_page_texts(pages: DataFrame) -> DataFrame:
    """pages(pair_id, side expected|actual, page, text): as align_pages() by token overlap (Jaccard), which is taken for the page
    pairs of the band alone where a pair is large, whatever words the pages share. Pages are taken in the order of their
    numbers and numbered from 1. Texts are dealt once by pair; to Python go pairs of unequal counts, with one 64-bit number a
    different word and page."""
    from formcheck.operators.compare import page_words

    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("page", "text")))).alias(s)
    pairs = pages.groupBy("pair_id").agg(listed("expected"), listed("actual"))
    n, m = F.size("expected"), F.size("actual")
    empty = F.array().cast("array<bigint>")
    words = lambda c: F.when(n != m, F.transform(c, lambda p: F.coalesce(F.transform(page_words(p["text"]), lambda w: F.xxhash64(w)), empty))).otherwise(F.array().cast("array<array<bigint>>")).alias(c)
    rows = pairs.select("pair_id", n.alias("n_expected"), m.alias("n_actual"), words("expected"), words("actual"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            out, sides = [], []
            for c in ("expected", "actual"):
                column = batch.column(c)
                sides.append((column.offsets.to_numpy(), column.values.offsets.to_numpy(), column.values.values.to_numpy()))
            own = lambda side, row: [side[2][side[1][k] : side[1][k + 1]] for k in range(side[0][row], side[0][row + 1])]
            for row, (n, m) in enumerate(zip(batch.column("n_expected").to_pylist(), batch.column("n_actual").to_pylist(), strict=True)):
                out.append(one_to_one(n) if n == m else align(n, m, _overlap([own(side, row) for side in sides])))
            yield _rows(batch.column("pair_id"), out)

    return rows.mapInArrow(run, f"pair_id {pages.schema['pair_id'].dataType.simpleString()}, {SCHEMA}")


@lru_cache(maxsize=64)
def _weights(size: int, to: int) -> np.ndarray:
    """(to, size) weights of Lanczos resampling with three lobes, in units of 2^-22: public definition of the filter, stretched
    where it shrinks, summing to one in each row."""
    scale = size / to
    wide = max(scale, 1.0)
    out = np.zeros((to, size))
    for x in range(to):
        centre = (x + 0.5) * scale
        first, last = max(0, int(centre - 3 * wide + 0.5)), min(size, int(centre + 3 * wide + 0.5))
        t = (np.arange(first, last) - centre + 0.5) / wide
        w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
        out[x, first:last] = np.round(w / w.sum() * (1 << 22))
    return out


def thumbnail(grey: np.ndarray, size: tuple[int, int] = THUMBNAIL) -> np.ndarray:
    """A grey page (rows x columns) at the given size (columns, rows): across first, then down, each to whole grey values.
    Sums are whole numbers below 2^53, so exact in floating point."""
    whole = lambda x: np.clip(np.floor((x + (1 << 21)) / (1 << 22)), 0, 255)
    across = whole(grey.astype(float) @ _weights(grey.shape[1], size[0]).T)
    return whole(_weights(grey.shape[0], size[1]) @ across).astype(np.uint8)


def thumbnails(pages: DataFrame) -> DataFrame:
    """pages(pair_id, side, page, width, height, pixels; one byte a pixel or three): pixels as thumbnails, page by page. A
    page without pixels is white."""
    from formcheck.operators.compare import luma

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, AT_ONCE) for whole in batches for k in range(0, whole.num_rows, AT_ONCE)):
            out = []
            for w, h, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels")), strict=True):
                if not data:
                    out.append(np.full(THUMBNAIL[0] * THUMBNAIL[1], 255, np.uint8).tobytes())
                    continue
                deep = np.frombuffer(data, np.uint8).reshape((h, w, 3) if len(data) == 3 * w * h else (h, w))
                out.append(thumbnail(luma(deep.astype(np.int64)) if deep.ndim == 3 else deep).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pair_id", "side", "page")), pa.array(out, pa.binary())], ["pair_id", "side", "page", "thumbnail"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("pair_id", "side", "page"))
    return pages.select("pair_id", "side", "page", "width", "height", "pixels").mapInArrow(run, f"{kinds}, thumbnail binary")


def thumbnail_likeness(expected: np.ndarray, actual: np.ndarray) -> Likeness:
    """Share of unchanged pixels of thumbnails (pages x pixels), computed where it is asked for."""

    def likeness(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for k in range(0, len(i), AT_ONCE):
            a, b = expected[i[k : k + AT_ONCE]], actual[j[k : k + AT_ONCE]]
            pct = (np.maximum(a, b) - np.minimum(a, b) > CHANGED).sum(axis=1) / a.shape[1] * 100
            out[k : k + AT_ONCE] = (100 - pct) / 100
        return out

    return likeness


def align_page_rasters(pages: DataFrame) -> DataFrame:
    """pages(pair_id, side expected|actual, page, width, height, pixels): as align_pages(), by the likeness of thumbnails; pages
    are taken in the order of their numbers and numbered from 1. Only thumbnails of pairs with unequal counts are
    grouped: 31,500 bytes a page, for two copies of 2,000 pages 126 MB."""
    sided = lambda s: F.count_if(F.col("side") == s)
    counts = pages.groupBy("pair_id").agg(sided("expected").alias("n_expected"), sided("actual").alias("n_actual"))
    unequal = counts.where("n_expected <> n_actual").select("pair_id")
    small = thumbnails(pages.join(unequal, "pair_id", "left_semi"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        some = left if len(left) else right
        if not len(some):
            return EMPTY
        size = THUMBNAIL[0] * THUMBNAIL[1]
        sides = [np.frombuffer(b"".join(x.sort_values("number").pixels), np.uint8).reshape(-1, size) for x in (left, right)]
        return _frame(some.iloc[0, 0], align(len(sides[0]), len(sides[1]), thumbnail_likeness(*sides)))

    kind = pages.schema["pair_id"].dataType.simpleString()
    # Renamed, as both sides stem from one table.
    side = lambda s, name: small.where(F.col("side") == s).select(F.col("pair_id").alias(name), F.col("page").alias("number"), F.col("thumbnail").alias("pixels")).groupBy(name)
    return _one_to_one(counts).unionByName(side("expected", "pair").cogroup(side("actual", "other")).applyInPandas(run, f"pair_id {kind}, {SCHEMA}"))
