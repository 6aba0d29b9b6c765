"""Token counts with a whole-token shortcut.

Method: merging each vocabulary string once, before the job, proves which of them encode alone as a single
token; the proven ids go to the tasks. A pre-token among those counts 1 at sight, only the others are merged
(see bpe.py), and a text's count is a sum over its pre-tokens: ids are never put together. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.bpe import counter, single_tokens
from formcheck.llm.common import read_table, text_or_empty
from formcheck.llm.words import bytes_of, slices

JSON = public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = JSON, limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null text is
    empty: 0 bytes, 0 tokens. Special strings inside a text count as one token each (.json files); nothing
    is added, cut off or padded. Repeated rows and null ids each keep their row."""

    proven = df.sparkSession.sparkContext.broadcast(single_tokens(vocabulary))  # one number per vocabulary string at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, proven.value)
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                sizes = count.sizes(*bytes_of(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes)], ["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
