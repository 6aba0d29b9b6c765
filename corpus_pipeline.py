"""Corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the docs of the next. All but the last return the columns of documents; the last returns the packed
pieces. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm import op2_toxicity, op3_exact_dedup, op5_minhash, op6_packing, op9_substring_dedup
from formcheck.llm.common import materialise, read_table


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its rows, and the key's name: doc_id where no id is null or repeats, else row numbers, fixed by
    a table in the shared folder."""
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id IS NULL OR count > 1").limit(1).count():
        return materialise(docs.withColumn("__fc_row", F.monotonically_increasing_id()), "rows"), "__fc_row"
    return docs, "doc_id"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go. Each row is judged by its own text, also where its id is null or repeats."""
    return op2_toxicity.accepted(docs, op2_toxicity.train(spark, docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    marked = op3_exact_dedup.mark(docs, op3_exact_dedup.DigestIndex(spark))
    kept = marked.where("kept").select("doc_id", "text_sha256")
    digest = op3_exact_dedup.digest(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & (digest == kept["text_sha256"])
    rows = docs.join(kept, same, "left_semi")
    # Rows that repeat id and text are one document: one of them stays. Texts are not shuffled for that where no id repeats.
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rows.dropDuplicates(["doc_id", "text"]) if repeated else rows


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    rows, key = _numbered(docs)
    kept = op5_minhash.near_duplicates(rows, key).where("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents are cut from all but the first; n_chars follows the text."""
    rows, key = _numbered(docs)
    return op9_substring_dedup.remove(rows, key).select(*docs.columns).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Classifier, sketches and tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
