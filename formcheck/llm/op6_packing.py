"""Packing of token sequences by non-negative least squares.

Method: documents are cut into full windows and one remainder each; the histogram of piece lengths has at
most WINDOW rows whatever the input. Shallow combinations of lengths (one to three pieces) that fill a
window are enumerated (a number bounded by the window), their repeat counts solved against the histogram by
non-negative least squares, rounded down, and what is left over is packed greedily, again on the histogram.
Each piece then finds its row of the plan by its rank within its length, so no task or driver sees all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formcheck.llm.bpe import encoder
from formcheck.llm.common import materialise, read_table, text_or_empty
from formcheck.llm.words import bytes_of, slices

JSON = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 2048
END = 1
#: Pairs may leave this many tokens of a window free; triples fill it.
SLACK = 8
#: Triples hold one of so many most frequent lengths.
FREQUENT = 8
#: Steps of the least-squares solver.
STEPS = 200


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = JSON, window: int = WINDOW, end: int = END) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of each document's pieces: its ids and the end id, cut at
    multiples of the window. A null or empty text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, sizes = encode_texts.encode(*bytes_of(part.column(1)))
                tokens = sizes + 1
                # The ids with an end id after each text, and the pieces as slices of them.
                last = np.cumsum(tokens) - 1
                own = np.full(int(tokens.sum()), end, "<u4")
                own[np.delete(np.arange(len(own)), last)] = ids
                count = -(-tokens // window)
                row = np.repeat(np.arange(len(tokens)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(window, tokens[row] - start)
                at = 4 * ((last + 1 - tokens)[row] + start)
                data = memoryview(own.tobytes())
                sums = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(tokens[row])], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(histogram: np.ndarray, window: int, slack: int = SLACK, frequent: int = FREQUENT) -> np.ndarray:
    """Rows of three lengths (0: none), largest first, that fill a window: full single pieces, pairs that
    leave at most slack free, triples that leave nothing and hold one of the `frequent` most frequent lengths.
    So there are at most window * (slack + 1 + frequent) of them, whatever the data."""
    lengths = np.flatnonzero(histogram)
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    found = [np.array([[window, 0, 0]])] if here[window] else []
    low = lengths[lengths < window]
    for gap in range(slack + 1):
        other = window - gap - low
        ok = (other >= 1) & (other <= low)
        a, b = low[ok], other[ok]
        keep = here[b]
        found.append(np.stack([a[keep], b[keep], np.zeros(keep.sum(), np.int64)], axis=1))
    for a in low[np.argsort(-histogram[low], kind="stable")[:frequent]].tolist():
        c = window - a - low
        ok = (c >= 1) & (c <= low)
        b, c = low[ok], c[ok]
        keep = here[c]
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], axis=1))
    return np.unique(np.sort(np.concatenate(found), axis=1)[:, ::-1], axis=0) if found else np.zeros((0, 3), np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, A counting each length in each combination;
    accelerated projected gradient."""
    n = len(histogram)
    used = combos > 0
    apply = lambda x: np.bincount(np.where(used, combos, 0).ravel(), np.repeat(x, 3) * used.ravel(), n)
    back = lambda r: np.where(used, r[combos], 0.0).sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(20):  # largest eigenvalue of A'A
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(apply(v))) + 1e-9)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(apply(y) - histogram))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (old - 1) / t * (new - x), new
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, last_rank, per, base, offset): the pieces of that length with ranks from
    first_rank to last_rank go, `per` to a sequence, to the sequences from `base` on, each after the other
    from `offset` on."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken = np.zeros(window + 1, np.int64)
    out: list[tuple[int, int, int, int, int, int]] = []
    base = 0

    def use(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal base
        offset = 0
        for length, per in parts:
            out.append((length, int(taken[length]), int(taken[length]) + per * times - 1, per, base, offset))
            taken[length] += per * times
            left[length] -= per * times
            offset += length * per
        base += times

    combos = combinations(left, window)
    if len(combos):
        x = solve(combos, left.astype(float))
        counts = np.floor(x + 1e-6).astype(np.int64)
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] < 1e-3:
                break
            parts = [(int(v), int(n)) for v, n in zip(*np.unique(combos[k][combos[k] > 0], return_counts=True), strict=True)][::-1]
            # Rounding: fractions are taken up to one where their lengths are still there.
            times = min([max(int(counts[k]), 1), *(int(left[v]) // n for v, n in parts)])
            if times > 0:
                use(parts, times)
    # What remains: the largest length first, then always the largest that still fits.
    while (there := np.flatnonzero(left)).size:
        gap, parts = window, []
        while gap > 0:
            fit = there[there <= gap]
            if not fit.size:
                break
            length = int(fit[-1])
            per = min(gap // length, int(left[length]))
            parts.append((length, per))
            gap -= per * length
            there = there[there < length]
        use(parts, min(int(left[v]) // n for v, n in parts))
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = JSON, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in one piece, every piece in one sequence of at most `window` tokens;
    offsets have no gaps. A null or empty text is the end id alone. Repeated rows are packed once each; a
    null id is kept. An empty table gives no rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(pieces(df, id_col, text_col, vocabulary, window, end), "pieces")
    # Ranks within a length in two steps, so that a frequent length is shared out among salts.
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(max(32, parts))).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start")) - 1
    ranked = salted.withColumn("own", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    # A few rows for each length and combination: bounded by the window, not by the data.
    rows = np.array(plan(histogram, window), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The plan row of each piece by a search for its length and rank: one row in, one row out."""
        rows = shared.value
        lengths = np.unique(rows[:, 0])
        low, high = np.searchsorted(rows[:, 0], lengths), np.searchsorted(rows[:, 0], lengths, "right")
        bounds = {n: (a, b) for n, a, b in zip(lengths.tolist(), low.tolist(), high.tolist(), strict=True)}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                a, b = bounds[int(length[own[0]])]
                at[own] = a + np.searchsorted(rows[a:b, 1], rank[own], "right") - 1
            _, first, _, per, base, offset = rows[at].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(base + k // per), pa.array(offset + k % per * length)], [*columns, "sequence_id", "offset"])

    columns = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = cut.schema["id"].dataType.simpleString()
    placed = ranked.select(*columns, "rank").mapInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
