"""Toxicity by a chain of linear classifiers.

Method: a classifier chain. Categories are judged one after the other; each linear model sees the words
of a text and the probabilities that the chain gave for the categories before. In training those
probabilities are out-of-fold predictions, so a later model never sees how well an earlier one fits its
own training rows. The models are fitted on a bounded sample of labelled rows (SAMPLE, by hash of the
id, drawn per class so that rare rows are all used); a text is then scored in one pass over it, without
a shuffle.

Categories, in chain order, all taken from the labels: `junk` (quality = 0), `toxic_clean` (toxic = 1 and
quality = 1: toxic but otherwise good text) and `toxic` (toxic = 1), which decides and sees both others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.common import materialise, read_table, text_or_empty
from formcheck.llm.words import mix, slices, span_hashes

#: At most about this many labelled rows are fitted on; words of a text beyond the hashed set add nothing.
SAMPLE = 6000
CATEGORIES = ("junk", "toxic_clean", "toxic")
#: The category that decides: the last, whose model sees the probabilities of both others.
DECIDES = 2
#: Hashed word features; the chained probabilities and the bias follow.
FEATURES = 1 << 18
#: Letters of a word's beginning.
BEGINNING = 4
FOLDS = 4
L2, STEPS = 1e-4, 60


@lru_cache
def letters() -> np.ndarray:
    """Which code points belong to words: letters and the like, no digits, no underscore."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), sorted and distinct: hashes of the lower-cased words of whole texts and, apart from them, of
    the words' beginnings, which hold for their other forms too."""
    texts = [t.lower() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 1, bool)
    inside[:-1] = letters()[points]
    heads = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    begin, over = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    over[:-1] &= ~inside[1:]
    tails = ends[ends > 0] - 1
    over[tails] = inside[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(over) + 1
    row = np.searchsorted(ends, start, "right")
    whole, head = span_hashes(points, start, end), mix(span_hashes(points, start, np.minimum(start + BEGINNING, end)) + np.uint64(1))
    each = np.concatenate([whole, head]) & np.uint64(FEATURES - 1)
    key = np.sort(np.concatenate([row, row]) * FEATURES + each.astype(np.int64))
    key = key[np.diff(key, prepend=-1) > 0]
    return key // FEATURES, key % FEATURES


class Rows:
    """Word sets as flat arrays: (row, feature) of n rows, sorted by row."""

    def __init__(self, row: np.ndarray, flat: np.ndarray, n: int):
        self.row, self.flat, self.n = row, flat, n

    @classmethod
    def of(cls, sets: list) -> Rows:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        return cls(np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.zeros(0, np.int64), *map(np.asarray, sets)]), len(sets))

    @staticmethod
    def _groups(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(sorted_, prepend=-1))
        return first, sorted_[first]

    @cached_property
    def by_row(self) -> tuple[np.ndarray, np.ndarray]:
        return self._groups(self.row)

    @cached_property
    def by_feature(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(self.flat, kind="stable")
        return self.row[order], *self._groups(self.flat[order])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        first, rows = self.by_row
        if len(first):
            out[rows] = np.add.reduceat(weights[self.flat], first)
        return out

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        row, first, features = self.by_feature
        if len(first):
            out[features] = np.add.reduceat(errors[row], first)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, size: int, stands: np.ndarray) -> np.ndarray:
    """Weights (size words, the dense columns, bias) of a logistic regression on the rows of mask `use`, classes
    weighted alike; accelerated gradient descent. A row stands for `stands` rows of its class. A word counts by
    how much its share differs between the classes (log-ratio, one text of the rarer class added to each
    share), so rare telling words are learnt in few steps."""
    ones, zeros = use & (y == 1), use & (y == 0)
    weight = sum(np.where(m, stands, 0.0) / (2 * max(1.0, stands[m].sum())) for m in (ones, zeros))
    pos, neg = max(1, ones.sum()), max(1, zeros.sum())
    share = lambda mask, total: rows.back(mask.astype(float), size) / total + 1 / min(pos, neg)
    ratio = np.log(share(ones, pos) / share(zeros, neg))
    dot = lambda v: rows.dot(ratio * v[:size]) + dense @ v[size:-1] + v[-1]
    back = lambda e: np.concatenate([ratio * rows.back(e, size), dense.T @ e, [e.sum()]])
    v = np.ones(size + dense.shape[1] + 1)
    for _ in range(12):  # largest curvature
        v = back(weight * dot(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (np.linalg.norm(back(weight * dot(v))) / 4 * 1.1 + L2)
    w = v = np.zeros(len(v))
    t = 1.0
    for _ in range(STEPS):
        g = back((_sigmoid(dot(v)) - y) * weight) + L2 * np.concatenate([v[:-1], [0.0]])
        new = v - step * g
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    w[:size] *= ratio
    return w


def fit_chain(rows: Rows, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS, stands: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, out): the words of the rows; per category, its weights for them, for the categories
    before (0 where there is none) and the bias; the out-of-fold probabilities. stands: the labelled rows that
    each row stands for (default: one)."""
    n = rows.n
    stands = np.ones(n) if stands is None else stands
    words, number = np.unique(rows.flat, return_inverse=True)
    rows = Rows(rows.row, number.astype(np.int32), n)
    size, k = len(words), labels.shape[1]
    weights = np.zeros((k, size + k + 1))
    dense = np.zeros((n, 0))
    for c in range(k):
        y = labels[:, c].astype(float)
        w = fit(rows, dense, y, np.ones(n, bool), size, stands)
        weights[c, : size + c] = w[: size + c]
        weights[c, -1] = w[-1]
        out = np.zeros(n)
        for f in range(folds):
            apart = fold == f
            if apart.any():
                wf = fit(rows, dense, y, ~apart, size, stands)
                out[apart] = _sigmoid(rows.dot(wf[:size]) + dense @ wf[size:-1] + wf[-1])[apart]
        dense = np.column_stack([dense, out])
    return words, weights, dense


def best_threshold(p: np.ndarray, y: np.ndarray, stands: np.ndarray | None = None) -> float:
    """The probability from which on rejecting gives the best F1 on out-of-fold predictions, each of which
    stands for `stands` labelled rows: the middle of the probabilities that do."""
    grid = np.arange(0.1, 0.95, 0.01)
    stands = np.ones(len(p)) if stands is None else stands
    f1 = np.array([2 * stands[y & (p >= t)].sum() / max(1, stands[y].sum() + stands[p >= t].sum()) for t in grid])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(grid[best[len(best) // 2]])


def shares(counts: dict, sample: int) -> dict:
    """The share of each class that is drawn: classes get equal parts of the sample, and what a class is too
    small to fill goes to the larger ones."""
    out, left = {}, sample
    for at, (kind, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        part = min(n, left / (len(counts) - at))
        out[kind] = part / n
        left -= part
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chain as one row (words array<long>, weights array<array<double>>, threshold double) in the shared folder.

    Labels with a null are left out; repeated ids count once each. The sample is taken by hash of the id, so
    it is the same for any partitioning, and per class (junk or not, toxic or not): all rows of a class up to
    its part of the sample. Rows stand for as many as their class has for each drawn. Without labelled rows every weight is zero."""
    # An id counts once for each of the four classes that its labels name.
    told = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, 0).otherwise(1).alias("quality"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).distinct()
    kind = [F.col("quality") == 0, F.col("toxic") == 1]
    drawn = shares({(r["junk"], r["bad"]): r["count"] for r in told.groupBy(kind[0].alias("junk"), kind[1].alias("bad")).count().collect()}, sample)
    share = F.lit(1.0)
    for (junk, bad), x in drawn.items():
        share = F.when((kind[0] == junk) & (kind[1] == bad), F.lit(x)).otherwise(share)
    chosen = told.withColumn("share", share).where(F.pmod(F.xxhash64("id"), F.lit(10**12)) < F.col("share") * 10**12)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5):
                row, feature = features(part.column(5).to_pylist())
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(5)), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))], ["id", "quality", "toxic", "stands", "fold", "words"])

    # What is drawn is bounded by `sample`, so it is sent to the texts.
    rows = F.broadcast(chosen).join(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "id")
    # Of several texts of an id one is taken, by hash, so what is fitted is bounded by `sample` as well.
    rows = rows.groupBy("id", "quality", "toxic", "share").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("id", "quality", "toxic", "share", "one.text")
    rows = rows.select("id", "quality", "toxic", (1 / F.col("share")).alias("stands"), F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:5])
    rows = rows.mapInArrow(words, f"{kinds}, words array<int>")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("quality", "ascending"), ("toxic", "ascending"), ("fold", "ascending")]).combine_chunks()
        toxic, junk = table["toxic"].to_numpy() == 1, table["quality"].to_numpy() == 0
        stands = table["stands"].to_numpy()
        words = table["words"].combine_chunks()
        sets = Rows(np.repeat(np.arange(len(words), dtype=np.int32), np.diff(words.offsets.to_numpy())), words.flatten().to_numpy(), len(words))
        kept, weights, out = fit_chain(sets, np.column_stack([junk, toxic & ~junk, toxic]), table["fold"].to_numpy(), stands=stands)
        each = pa.ListArray.from_arrays(np.arange(0, weights.size + 1, weights.shape[1], dtype=np.int32), pa.array(weights.ravel()))
        nested = lambda values: pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), values)
        return pa.table({"words": nested(pa.array(kept.astype(np.int64))), "weights": nested(each), "threshold": [best_threshold(out[:, DECIDES], toxic, stands)]})

    # One group of at most about `sample` rows: the bound is the parameter, not the data.
    fitted = materialise(rows.withColumn("all", F.lit(1)), "labelled").groupBy("all").applyInArrow(run, "words array<long>, weights array<array<double>>, threshold double")
    return materialise(fitted, "toxicity-chain")


def _judge(docs: DataFrame, chain: DataFrame, threshold: float | None):
    """Function from texts to their probabilities by category and the threshold, for use in the tasks."""
    # The chain is at most FEATURES words times three categories, whatever the data.
    row = chain.first()
    threshold = threshold if threshold is not None else row["threshold"] if row else 1.0
    words = np.array(row["words"] if row else [], np.int64)
    weights = np.array(row["weights"] if row else np.zeros((len(CATEGORIES), len(CATEGORIES) + 1)))
    table = np.zeros((FEATURES, len(CATEGORIES)), np.float32)
    table[words] = weights[:, : len(words)].T
    shared = docs.sparkSession.sparkContext.broadcast((table, weights[:, len(words) : -1], weights[:, -1], bool(len(words))))

    def judge(texts: list[str]) -> list[np.ndarray]:
        table, chained, bias, trained = shared.value
        rows = Rows(*features(texts), len(texts))
        some = (np.bincount(rows.row, minlength=len(texts)) > 0) & trained
        probs: list[np.ndarray] = []
        for c in range(len(CATEGORIES)):
            z = rows.dot(table[:, c]) + bias[c]
            for k, p in enumerate(probs):
                z = z + chained[c, k] * p
            probs.append(np.where(some, _sigmoid(z), 0.0))
        return probs

    return judge, threshold


def score(docs: DataFrame, chain: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """One row per input row: id, p_junk, p_toxic_clean, p_toxic, rejected.

    Rejected are texts whose toxic probability reaches the threshold (default: the chain's own, calibrated
    on out-of-fold predictions). A null or empty text has no words and is never rejected; without a chain (no labelled rows) nothing is.
    Repeated rows score alike."""
    judge, threshold = _judge(docs, chain, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                probs = judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, probs), pa.array(probs[DECIDES] >= threshold)], ["id", *(f"p_{c}" for c in CATEGORIES), "rejected"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", rejected boolean"
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, chain: DataFrame, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of docs that score() does not reject, with all their columns and without a shuffle."""
    judge, threshold = _judge(docs, chain, threshold)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(judge([t or "" for t in part.column(at).to_pylist()])[DECIDES] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(spark, docs, read_table(spark, sf_dir, "labels")))
