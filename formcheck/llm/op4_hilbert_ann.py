"""Approximate nearest neighbours on shifted space-filling curves.

Method: each vector is projected to DIMENSIONS orthogonal directions, shifted at random, and ordered by its
Hilbert key; CURVES such orderings differ in directions and shift. Spark range-partitions and sorts the keys
of all curves; a query meets the vectors next to it in each ordering, compared by codes of at most CODE bytes,
which travel in place of the vectors. The windows of all curves merge, the best SHORTLIST candidates by code are
ranked again by the exact cosine of the original vectors.

A window has WIDTH * sqrt(n) vectors on each side: on vectors without structure a fixed number would lose
recall as tables grow. Work is thus n^1.5, not n^2: the codes compared for a query are about
2 * CURVES * WIDTH / sqrt(n) of the table (once at 10,000 vectors, a third at 100,000, a hundredth at 100
million), the vectors scored SHORTLIST.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formcheck.llm.common import join_groups, materialise, read_table

CURVES, DIMENSIONS = 64, 12
#: Bits of a coordinate; a key has DIMENSIONS times as many.
BITS = 5
#: Bytes by which vectors are compared before they are scored: one for each of at most so many components.
CODE = 64
#: Vectors on each side of a query in an ordering: WIDTH times the root of their number.
WIDTH = 0.8
#: Candidates that a query keeps of an ordering, and that are scored for it in the end, at least: 2 and 4 times as many as
#: neighbours are asked for.
KEPT, SHORTLIST = 16, 64
#: Keys of a range partition at least; it holds SPAN windows, so that its ends, where one is cut short, are a small part.
PART, SPAN = 65536, 16
SEED = 11


def curves(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(directions, shift) of each curve; from a fixed seed, so the same in every task."""
    random = np.random.default_rng([SEED, dim])
    wide = max(dim, DIMENSIONS)
    return [(np.linalg.qr(random.normal(size=(wide, DIMENSIONS)))[0][:dim] * sqrt(dim), random.uniform(0, 1, DIMENSIONS)) for _ in range(CURVES)]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (rows), by exchange and inversion of bits from the top down."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def keys(unit: np.ndarray) -> np.ndarray:
    """(rows, CURVES) keys of unit vectors. Their projections have variance 1: four deviations each way are kept."""
    out = []
    for directions, shift in curves(unit.shape[1]):
        place = (unit @ directions + 4 + shift) / 9
        out.append(hilbert((np.clip(place, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64)))
    return np.stack(out, axis=1)


def codes(unit: np.ndarray) -> np.ndarray:
    """(rows, at most CODE) bytes: the components of unit vectors in an orthogonal system, largest 127."""
    dim = unit.shape[1]
    system = np.linalg.qr(np.random.default_rng([SEED, dim, 1]).normal(size=(dim, min(dim, CODE))))[0]
    turned = unit @ system
    return np.round(127 * turned / np.maximum(np.abs(turned).max(axis=1), 1e-12)[:, None]).astype(np.int8)


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def neighbours(curve: np.ndarray, code: np.ndarray, queries: np.ndarray, width: int, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, closeness): of each query row (a position in the sorted rows) the `kept` rows whose codes are closest
    among the `width` before and after it that are of the same curve; itself among them."""
    code = code.astype(np.float32)
    code /= np.maximum(np.linalg.norm(code, axis=1), 1e-12)[:, None]
    low, high = np.searchsorted(curve, curve[queries], "left"), np.searchsorted(curve, curve[queries], "right")
    low, high = np.maximum(low, queries - width), np.minimum(high, queries + width + 1)
    rows, values = [], []
    for q, a, b in zip(queries.tolist(), low.tolist(), high.tolist(), strict=True):
        close = code[a:b] @ code[q]
        best = np.argpartition(-close, kept - 1)[:kept] if b - a > kept else np.arange(b - a)
        rows.append(a + best)
        values.append(close[best])
    sizes = [len(r) for r in rows]
    return np.repeat(queries, sizes), np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.float32), *values])


def knn(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row that the condition is_query selects.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another
    length than the most frequent (ties: the greater). A row is no candidate of its own id. Ids are long; null ids
    take no part. Of rows that repeat an id and a vector one counts; an id with several vectors counts with
    each, at its best score. Equal vectors are one point of the orderings, which answers with its k + 1 smallest ids, so ties
    are exact however many copies there are. A window has 2 * k vectors on each side at least, so fewer than k
    candidates are all found. No valid vector: no rows."""
    spark = df.sparkSession
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    )
    sizes = valid.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in vectors], pa.binary()), batch.column(2)], ["id", "v", "query"])

    rows = valid.where(F.size(v) == sizes["dim"]).mapInArrow(packed, "id long, v binary, query boolean")
    rows = materialise(rows.groupBy("id", "v").agg(F.max("query").alias("query")), "vectors")
    # Points: distinct vectors, with their smallest ids.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.select("id", "v").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.groupBy("v").agg(F.max("query").alias("asked"), F.count(F.lit(1)).alias("copies"))
    # Numbers name the points from here on; the written table fixes them.
    points = materialise(points.join(asked, "v").withColumn("point", F.monotonically_increasing_id()), "points")
    count = points.count()
    width, kept, shortlist = max(2 * k, ceil(WIDTH * sqrt(count))), max(KEPT, 2 * k), max(SHORTLIST, 4 * k)

    def curve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors = _vectors(part.column(1))
                unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
                own, words = keys(unit), pa.array([x.tobytes() for x in codes(unit)], pa.binary())
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, c, np.int32)), pa.array(own[:, c]), part.column(0), part.column(2), words], ["curve", "key", "point", "asked", "code"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A range partition: narrow rows, as many as some windows have.
        whole = pa.Table.from_batches(list(batches), pa.schema([("curve", pa.int32()), ("key", pa.int64()), ("point", pa.int64()), ("asked", pa.bool_()), ("code", pa.binary())])).combine_chunks()
        if len(whole):
            code = np.frombuffer(b"".join(whole["code"].to_pylist()), np.int8).reshape(len(whole), -1)
            q, row, close = neighbours(whole["curve"].to_numpy(), code, np.flatnonzero(whole["asked"].to_numpy(zero_copy_only=False)), width, kept)
            name = whole["point"].combine_chunks()
            yield pa.RecordBatch.from_arrays([name.take(pa.array(q)), name.take(pa.array(row)), pa.array(close)], ["query", "point", "close"])

    ordered = points.select("point", "v", "asked").mapInArrow(curve_rows, "curve int, key long, point long, asked boolean, code binary")
    parts = max(1, ceil(count * CURVES / max(PART, SPAN * width)))
    ordered = ordered.repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    met = ordered.mapInArrow(windows, "query long, point long, close float").groupBy("query", "point").agg(F.max("close").alias("close"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("close"), "point"))
    short = met.withColumn("nth", best).where(F.col("nth") <= shortlist).select("query", "point")
    pairs = short.join(points.select("point", F.col("v").alias("candidate"), "ids"), "point").join(points.select(F.col("point").alias("query"), "v", "copies"), "query").select("query", "v", "candidate", "ids", "copies")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _vectors(batch.column(1)), _vectors(batch.column(2))
                cosine = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(cosine)], ["query", "ids", "copies", "score"])

    scored = pairs.mapInArrow(exact, "query long, ids array<long>, copies long, score double").select("query", "copies", F.explode("ids").alias("id"), "score")
    # An answer of a point holds k + 1 ids, so k are left without the asking one, whichever copy asks.
    scored = scored.groupBy("query", "copies", "id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    answers = materialise(scored.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("query", "copies").agg(F.collect_list(F.struct("score", "id")).alias("near")), "answers")
    # Copies that ask share their point's answer; a point of very many copies is a hot key.
    named = points.select("v", F.col("point").alias("query"), F.col("copies").alias("n"))
    asking = join_groups(rows.where("query").select(F.col("id").alias("query_id"), "v"), named, ["v"], "n").select("query_id", "query")
    found = join_groups(asking, answers.withColumnRenamed("copies", "n"), ["query"], "n").select("query_id", F.explode("near").alias("near"))
    found = found.where("near.id <> query_id").groupBy("query_id", F.col("near.id").alias("vec_id")).agg(F.max("near.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
