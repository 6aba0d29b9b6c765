"""Substring dedup by content-defined chunking.

Method: a gear rolling hash runs over the bytes; a word begins a new chunk where the hash at its start is
the least among its REACH neighbours on each side. Boundaries depend on nearby bytes alone, so an
insertion shifts no later one and a passage shared by two documents is cut alike inside. Chunks are
deduplicated by a 128-bit digest: a chunk stays in the document of the smallest id and is a copy in all
others. A stretch of copies is removed when it has at least LEAST words; a shared passage of over 50
words holds such a stretch, shared lines and chance matches do not.

Only digests are shuffled, never text: each distinct digest is reduced to its smallest and largest
document (partial aggregation first), and chunks come back only for digests of more than one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.common import keyed, materialise, read_table, release, text_or_empty
from formcheck.llm.words import Words, bytes_of, slices

#: A chunk begins where the hash is least among this many words on each side: REACH + 1 words at least.
REACH = 4
#: Bytes of the rolling window.
GEAR_BYTES = 16
#: A chunk without a boundary is cut after this many words, so that text that repeats one word is cut alike too.
LONGEST = 16
#: Words of a stretch of copies from which on it is removed.
LEAST = 24
#: At most this many digests can hold more than 1/HOT of all copies each.
HOT = 200
#: Random 32-bit gear of each byte, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hash(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gear hash at every byte position p of the GEAR_BYTES bytes before p, within the document: doubling
    gives h[p] = sum of GEAR[byte p - 1 - j] << j. One more position than bytes."""
    h = np.concatenate([np.zeros(1, np.uint32), GEAR[text]])
    depth = np.arange(1, len(text) + 1) - np.repeat(offsets[:-1], np.diff(offsets))
    width = 1
    while width < GEAR_BYTES:
        add = np.zeros(len(h), np.uint32)
        add[width:] = h[:-width] << np.uint32(width)
        add[1:][depth <= width] = 0
        h += add
        width *= 2
    return h


def chunk(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, start, end, words) of every chunk: positions in the row's bytes; chunks of a row follow
    one another without a gap from its first word to its end."""
    text, offsets = bytes_of(column)
    words = Words(text, offsets, hashed=False)
    n = len(words.start)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    row = words.row
    # The window ends inside the word's first bytes: the words before alone would tie repeated words.
    at = np.minimum(words.start + 4, words.end)
    value = gear_hash(text, offsets)[at].astype(np.int64)
    least = np.ones(n, bool)
    for k in range(1, REACH + 1):
        same = row[k:] == row[:-k]
        least[k:] &= ~same | (value[k:] < value[:-k])
        least[:-k] &= ~same | (value[:-k] <= value[k:])
    begin = least
    begin[words.first[:-1][np.diff(words.first) > 0]] = True
    since = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    begin |= since % LONGEST == 0
    first = np.flatnonzero(begin)
    rows = row[first]
    start = words.start[first] - offsets[rows]
    end = np.concatenate([words.start[first[1:]], [0]])
    last = np.concatenate([rows[1:] != rows[:-1], [True]])
    end = np.where(last, offsets[rows + 1], end) - offsets[rows]
    size = np.diff(np.concatenate([first, [n]]))
    number = np.arange(len(first)) - np.searchsorted(rows, rows)
    return rows, number, start, end, size


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: id, d1 and d2 (128-bit digest), span (start << 32 | end, bytes), place (number in
    the document << 16 | words). Packed, as these rows are what is shuffled. Texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = hashlib.blake2b
        for batch in batches:
            for part in slices(batch, 1):
                rows, number, start, end, size = chunk(part.column(1))
                text, offsets = bytes_of(part.column(1))
                data = text.tobytes()
                # White space at the end is none of the chunk's content: what follows differs.
                ends = zip((start + offsets[rows]).tolist(), (end + offsets[rows]).tolist(), strict=True)
                digests = np.frombuffer(b"".join(blake(data[a:b].rstrip(), digest_size=16).digest() for a, b in ends), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), *map(pa.array, (digests[:, 0], digests[:, 1], start << 32 | end, number << 16 | size))],
                    ["id", "d1", "d2", "span", "place"],
                )

    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, d1 long, d2 long, span long, place long")


def duplicate_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document that has something to remove: id, starts and ends (byte positions) and words of
    each stretch, and sources: the ids of the documents that keep those chunks.

    The document with the smallest id keeps a chunk; a chunk that only one document has, however often, is
    no copy. Null ids are left out: such rows neither lose nor take text. Rows with an equal id count as one
    document."""
    cut = materialise(chunks(df.where(F.col(id_col).isNotNull()), id_col, text_col), "chunks")
    key = ["d1", "d2"]
    shared = cut.groupBy(*key).agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("keeper < last").drop("last")
    shared = materialise(shared, "shared-chunks")
    copies = shared.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * HOT > F.lit(copies)
    hot, rest = F.broadcast(shared.where(large).select(*key, F.col("keeper").alias("hot"))), shared.where(~large).select(*key, "keeper")
    tagged = cut.join(hot, key, "left")
    cold = tagged.where("hot IS NULL").drop("hot").join(rest, key)
    found = cold.unionByName(tagged.where("hot IS NOT NULL").withColumnRenamed("hot", "keeper")).where("keeper <> id")
    # A group is what one document shares: bounded by its text.
    lists = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "span", "keeper"))).alias("found"))
    kind = df.schema[id_col].dataType.simpleString()

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: list[list] = []
                after = -1
                for c in found:
                    number, words, start, end = c["place"] >> 16, c["place"] & 0xFFFF, c["span"] >> 32, c["span"] & 0xFFFFFFFF
                    if own and number <= after:
                        own[-1][1] = max(own[-1][1], end)
                        own[-1][2] += words
                        own[-1][3].add(c["keeper"])
                    else:
                        own.append([start, end, words, {c["keeper"]}])
                    after = number + 1
                if own := [x for x in own if x[2] >= least]:
                    rows.append((id_, *(list(x) for x in list(zip(*own, strict=True))[:3]), sorted(set().union(*(x[3] for x in own)))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.list_(pa.int32())) for c in columns[1:4]), pa.array(columns[4], pa.list_(batch.schema.field(0).type))], ["id", "starts", "ends", "words", "sources"])

    spans = materialise(lists.mapInArrow(stretches, f"id {kind}, starts array<int>, ends array<int>, words array<int>, sources array<{kind}>"), "spans")
    release(cut, shared)
    return spans.withColumnRenamed("id", id_col)


def _without(text: str, starts: list[int], ends: list[int]) -> str:
    data, kept, at = text.encode(), [], 0
    for start, end in zip(starts, ends, strict=True):
        kept.append(data[at:start])
        at = end
    return (b"".join(kept) + data[at:]).decode(errors="ignore")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The same rows and columns; from each text the stretches of copies are cut out. A text that is wholly
    copied becomes empty; nulls stay null. Rows with a null id are left as they are; rows that repeat an id are cut each by
    its own text, and stand in an order of their own.

    Spans grow with the corpus, so the join is a merge join at every size: texts are shuffled once."""
    rows, key = df, id_col
    if df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count():
        rows, key = keyed(df, id_col)
        rows = rows.withColumn(key, F.when(F.col(id_col).isNotNull(), F.col(key)))
    spans = duplicate_spans(rows, key, text_col, least).select(F.col(key).alias("__fc_id"), F.col("starts").alias("__fc_starts"), F.col("ends").alias("__fc_ends"))
    joined = rows.join(spans.hint("merge"), F.col(key) == F.col("__fc_id"), "left").select(*df.columns, "__fc_starts", "__fc_ends")
    at = df.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                text, starts, ends = part.column(at), part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                if starts.null_count < part.num_rows:
                    # One pass over the rows that lose something; the others are taken as they are.
                    some = pc.and_(pc.is_valid(starts), pc.is_valid(text))
                    new = [_without(*x) for x in zip(*(c.filter(some).to_pylist() for c in (text, starts, ends)), strict=True)]
                    text = pc.replace_with_mask(text, some, pa.array(new, text.type))
                yield pa.RecordBatch.from_arrays([text if k == at else part.column(k) for k in range(len(part.schema) - 2)], part.schema.names[:-2])

    return joined.mapInArrow(cut, df.schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_spans, removed_words, removed_bytes, starts, ends, source_ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return docs.select("doc_id").join(duplicate_spans(docs), "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("starts"), F.lit(0)).alias("n_spans"), total(F.col("words")).alias("removed_words"),
        (total(F.col("ends")) - total(F.col("starts"))).alias("removed_bytes"), "starts", "ends", F.col("sources").alias("source_ids"),
    )
