"""Alignment of two tokenizers over the same texts.

Method, per batch of documents: tokens of either side are rows (document, first byte), and pandas merge_asof, keyed by
document, finds for each token start the other side's token that covers it. The union of both directions is the
links, the pairs of tokens whose bytes overlap; equal ends cut both sides into groups.

Corpus-wide counts of id pairs are reduced in each batch before they are shuffled: a batch is written as one row
with its different pairs and, link by link, their numbers; its pairs are counted with those of the others and
what they came to is joined back by batch. So a pair that every document has is one row a batch, and the few
that still hold many rows are joined by broadcast.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.bpe import Encoder, ragged
from formcheck.llm.common import join_groups, materialise, read_table, release, settle, text_or_empty
from formcheck.llm.words import bytes_of, slices

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text in a batch, about: its row stays small for the JVM. Bytes of pre-tokens that a worker keeps for each side.
BATCH, KEPT = 3 << 17, 12_000_000
BLANK = 0x20


class PlainEncoder(Encoder):
    """The byte-level tokenizer; special strings inside texts are plain text."""

    most = KEPT

    def __init__(self, path: str):
        super().__init__(path)
        self.special = None


class PieceEncoder(Encoder):
    """A piece tokenizer whose pieces have blanks only at their start: a text is cut before each run of blanks, and the
    library encodes each such part once. Ids as the library gives them for the whole text without its first blank."""

    most = KEPT

    class _Plain:
        special: dict = {}

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"pieces with inner blanks: {path}")
        #: Bytes of each id.
        self.pieces = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.library.piece_to_id("▁")
        self.vocabulary, self.pattern, self.special = self._Plain, None, None
        self._forget()

    def _starts(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        begin = text == BLANK
        begin[1:] &= text[:-1] != BLANK
        begin[bounds[bounds < len(text)]] = True
        return np.flatnonzero(begin)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # The library puts one blank before what it encodes, save before nothing.
        lists = [x if x else [self.blank] for x in self.library.encode([p[1:].decode() for p in pieces], num_threads=1)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum())), sizes


class Table:
    """Byte strings by number, one after another."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(strings), np.uint8)

    def take(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.data, self.starts[ids], self.sizes[ids])


class Side:
    """One tokenizer: its encoder, and the bytes of its tokens."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            self.encoder = PieceEncoder(path)
            self.bytes = Table(self.encoder.pieces)
        else:
            self.encoder = PlainEncoder(path)
            starts, sizes, data = self.encoder.vocabulary.token_table
            self.bytes = Table([data[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        self.decimal = Table([str(i).encode() for i in range(len(self.bytes.sizes))])

    def tokens(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, row, sound): tokens of all texts, and which rows their bytes give back."""
        ids, count = self.encoder.encode(text, offsets)
        row = np.repeat(np.arange(len(count)), count)
        size = np.bincount(row, weights=self.bytes.sizes[ids], minlength=len(count)).astype(np.int64)
        sound = size == np.diff(offsets)
        kept = sound[row]
        ours, theirs = self.bytes.take(ids[kept]), ragged(text, offsets[:-1][sound], np.diff(offsets)[sound])
        if not np.array_equal(ours, theirs):
            wrong = np.repeat(np.flatnonzero(sound), size[sound])[ours != theirs]
            sound[wrong] = False
        return ids, row, sound


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    """The worker's encoders, kept between tasks."""
    return Side(path)


def covering(left: np.ndarray, left_row: np.ndarray, right: np.ndarray, right_row: np.ndarray) -> np.ndarray:
    """For each left token start the number of the right token of the same document that begins last at or before it."""
    one, two = pd.DataFrame({"at": left, "row": left_row}), pd.DataFrame({"at": right, "row": right_row, "token": np.arange(len(right))})
    return pd.merge_asof(one, two, on="at", by="row")["token"].to_numpy()


class Alignment:
    """Tokens of a batch on both sides, its links (a, b: numbers of tokens) and groups."""

    def __init__(self, first: Side, second: Side, text: np.ndarray, offsets: np.ndarray):
        """text: each document with a blank before it."""
        a, a_row, sound = first.tokens(text, offsets)
        b, b_row, also = second.tokens(text, offsets)
        sound &= also
        self.documents = len(offsets) - 1
        self.a, self.a_row = a[sound[a_row]], a_row[sound[a_row]]
        self.b, self.b_row = b[sound[b_row]], b_row[sound[b_row]]
        # The documents left stand one after another, so positions in the batch rise with the tokens.
        a_end, b_end = np.cumsum(first.bytes.sizes[self.a]), np.cumsum(second.bytes.sizes[self.b])
        a_at, b_at = a_end - first.bytes.sizes[self.a], b_end - second.bytes.sizes[self.b]
        over_a, over_b = covering(a_at, self.a_row, b_at, self.b_row), covering(b_at, self.b_row, a_at, self.a_row)
        # A pair that begins together is found from both sides; it counts once.
        new = b_at != a_at[over_b] if len(over_b) else np.zeros(0, bool)
        link_a, link_b = np.concatenate([np.arange(len(self.a)), over_b[new]]), np.concatenate([over_a, np.flatnonzero(new)])
        order = np.argsort(link_a, kind="stable")
        self.link_a, self.link_b = link_a[order], link_b[order]
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(ends, a_at, "right"), np.searchsorted(ends, b_at, "right")
        self.groups = len(ends)
        # A document's last tokens end together.
        self.group_row = self.a_row[np.searchsorted(a_end, ends)]

    def group_strings(self, first: Side, second: Side) -> list[bytes]:
        """For each document `a1,a2|b1;a3|b2,b3`."""
        before_b, before_a = np.searchsorted(self.group_b, np.arange(self.groups + 1)), np.searchsorted(self.group_a, np.arange(self.groups + 1))
        n = len(self.a) + len(self.b)
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + before_a[self.group_b + 1]
        size, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        size[at_a], size[at_b] = first.decimal.sizes[self.a] + 1, second.decimal.sizes[self.b] + 1
        mark[at_a[before_a[1:] - 1]] = ord("|")
        mark[at_b[before_b[1:] - 1]] = ord(";")
        end = np.cumsum(size)
        out = np.zeros(int(end[-1]) if n else 0, np.uint8)
        for table, ids, at in ((first.decimal, self.a, at_a), (second.decimal, self.b, at_b)):
            length = table.sizes[ids]
            out[ragged(np.arange(len(out)), end[at] - length - 1, length)] = table.take(ids)
        out[end - 1] = mark
        row = np.zeros(n, np.int64)
        row[at_a], row[at_b] = self.a_row, self.b_row
        bound = np.append(0, end)[np.searchsorted(row, np.arange(self.documents + 1))]
        data = out.tobytes()
        return [data[p : max(p, q - 1)] for p, q in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def _full(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with a blank before each; empty ones stay empty."""
    text = part.column(1)
    return bytes_of(pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(" ", text, "")))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = BYTE_BPE, second: str = PIECES) -> DataFrame:
    """One row per link, in the order of a document's bytes: id, a_number, a_id, b_number, b_id (numbers count a document's
    tokens from 0). Null and empty texts, and texts that the tokens of a side do not give back, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(first), side(second)
        for batch in batches:
            for part in slices(batch, 1, BATCH):
                own = Alignment(one, two, *_full(part))
                row = own.a_row[own.link_a]
                starts = [np.searchsorted(x, np.arange(own.documents)) for x in (own.a_row, own.b_row)]
                columns = (own.link_a - starts[0][row], own.a[own.link_a], own.link_b - starts[1][row], own.b[own.link_b])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, columns)], ["id", "a_number", "a_id", "b_number", "b_id"])

    rows = _texts(df, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a_number long, a_id int, b_number long, b_id int").withColumnRenamed("id", id_col)


def _batches(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row per batch of documents: batch (its name), per document id, n_a, n_b, n_groups, n_links, sha; its different
    pairs (a << 32 | b), the most frequent first, with counts; and pair by pair number of all its links, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(first), side(second)
        for batch in batches:
            for part in slices(batch, 1, BATCH):
                own = Alignment(one, two, *_full(part))
                n = own.documents
                count = lambda row: np.bincount(row, minlength=n)  # noqa: E731, B023
                n_a = count(own.a_row)
                strings = own.group_strings(one, two)
                sha = [hashlib.sha256(s).hexdigest() if has else "" for s, has in zip(strings, (n_a > 0).tolist(), strict=True)]
                pair = own.a[own.link_a].astype(np.int64) << 32 | own.b[own.link_b]
                kinds, number, times = np.unique(pair, return_inverse=True, return_counts=True)
                # Small numbers for frequent pairs: they compress well.
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                listed = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0))
                numbers = (n_a, count(own.b_row), count(own.group_row), count(own.a_row[own.link_a]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([secrets.token_hex(12)]), listed, *(whole(x, pa.int64()) for x in numbers), whole(sha, pa.string()), whole(kinds[order], pa.int64()), whole(times[order], pa.int64()), pa.array([pa.compress(rank[number].tobytes(), "zstd", asbytes=True)], pa.binary())],
                    ["batch", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "pairs", "times", "linked"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"batch string, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, pairs array<long>, times array<long>, linked binary")


def _counted(written: DataFrame) -> DataFrame:
    """(batch, found): of each batch a list of (place of the pair in it, its count over all batches, best) - best: no
    other pair with that b counts more."""
    rows = written.select("batch", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p")).select("batch", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = rows.groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = materialise(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    # Pairs and ids of b are bounded by the vocabularies, whatever the corpus.
    judged = counts.join(most, "b").select("pair", "n", "count", (F.col("count") == F.col("most")).alias("best"))
    # A batch has its own pairs only: bounded by its text.
    return materialise(join_groups(rows.select("batch", "place", "pair"), judged, ["pair"]).groupBy("batch").agg(F.collect_list(F.struct("place", "count", "best")).alias("found")), "counted-pairs")


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = BYTE_BPE, second: str = PIECES) -> DataFrame:
    """One row per input row: id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair count over the corpus is
    the highest of their b), count_sum (pair counts summed over the links), groups_sha256. Null and empty texts, and
    texts that the tokens of a side do not give back, have zeros and an empty digest. Repeated rows and null ids each
    keep their row, and count each time. A document is in one batch whole."""
    rows = _texts(df, id_col, text_col)
    written = materialise(_batches(rows, first, second), "batches", "zstd")
    settle(df.sparkSession)
    found = _counted(written)
    settle(df.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_a, n_b, n_groups, n_links, sha = (batch.column(c)[k].values for c in range(6))
                count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if batch.column(7)[k].is_valid:
                    own = batch.column(7)[k].values
                    place = own.field(0).to_numpy()
                    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                    count[place], best[place] = own.field(1).to_numpy(), own.field(2).to_numpy(zero_copy_only=False)
                bound = np.append(0, np.cumsum(n_links.to_numpy()))
                linked = np.frombuffer(pa.decompress(batch.column(6)[k].as_py(), int(bound[-1]) * 4, "zstd", asbytes=True), np.int32)
                over = lambda x: np.diff(np.append(0, np.cumsum(x[linked]))[bound])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([ids, n_a, n_b, n_groups, n_links, pa.array(over(best)), pa.array(over(count)), sha], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = written.select("batch", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "linked").join(found.hint("merge"), "batch", "left").drop("batch")
    out = materialise(joined.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "aligned")
    release(written, found)
    return out.withColumnRenamed("id", id_col)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"))
