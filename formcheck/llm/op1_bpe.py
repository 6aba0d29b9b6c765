"""Byte-level BPE encoding and decoding.

Method: length-bucketed padded numpy matrices (see bpe.py). One pass over the text, no shuffle: each
Arrow batch is encoded, digested and decoded inside its task, and only ids or digests leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.bpe import encoder
from formcheck.llm.common import read_table, text_or_empty
from formcheck.llm.words import bytes_of, slices

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = MULTI, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per input row: its id and ids array<int>. A null text is empty and has no ids; repeated
    rows each get a row; a null id is kept. Special tokens are neither added nor recognised in .tiktoken
    files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, sizes = encode_texts.encode(*bytes_of(part.column(1)))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = MULTI) -> DataFrame:
    """One row per input row: its id and the bytes that its ids stand for (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.decode(np.array(x or [], np.int64)) for x in lists], pa.binary())], ["id", "bytes"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = MULTI, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode, then decode, each text in one pass; only the digests of both leave the task. Nulls, empty
    texts and repeated rows as in encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(vocabulary, pattern)
        _, lengths, _ = encode_texts.vocabulary.token_table
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, sizes = encode_texts.encode(*bytes_of(part.column(1)))
                ends = np.cumsum(sizes)
                data, back = memoryview(ids.astype("<u4").tobytes()), memoryview(encode_texts.decode(ids))
                after = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], ends])].tolist()
                shas = [sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                decoded = [sha256(back[a:b]).hexdigest() for a, b in zip(after[:-1], after[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(shas), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))
