"""Exact dedup against a persistent digest index.

Method [native]: the index is a table bucketed and sorted by digest. New data is reduced to one row per
digest (partial aggregation before the shuffle), sort-merge anti-joined with the index and appended to
it. Rows are then marked through a join on the digest; the digests that hold more than 1/HOT of all rows
(at most HOT of them) are joined by broadcast, so no task gets a hot group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formcheck.llm.common import join_groups, lower_ascii, materialise, path_exists, read_table, shared_path, text_or_empty

#: Batches in which the query feeds its table to the index.
BATCHES = 2


def digest(text: Column) -> Column:
    return F.sha2(lower_ascii(text), 256)


class DigestIndex:
    """Persistent table (digest, keep_id, group_size, batch), bucketed and sorted by digest. It exists, empty, from the
    start, so that every batch is joined with it.

    It outlives the session: opened again by its path in a session whose catalog does not know it, its files are
    registered as they are, with the buckets they were written in, and nothing is written over them. A name that the
    catalog knows opens that table; with the path of another one it is an error."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None, id_type: str = "long"):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.name):
            told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {self.name}").collect()}
            if path and not told["Location"].rstrip("/").endswith(path.rstrip("/").removeprefix("file:")):
                raise ValueError(f"{self.name} lies at {told['Location']}, not at {path}")
            self.path, self.buckets = path or told["Location"], int(told["Num Buckets"])
            return
        self.path = path or shared_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # A folder whose name begins with _ is none of the table's data. It is written whole before the first batch.
        about = f"{self.path}/_about"
        if path_exists(spark, f"{about}/_SUCCESS"):
            kept = spark.read.schema("buckets int, id_type string").parquet(about).first()
            self.buckets, id_type = kept["buckets"], kept["id_type"]
        else:
            spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string").coalesce(1).write.mode("overwrite").parquet(about)
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {id_type}, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _write(self, rows: DataFrame) -> None:
        """One file a bucket and call."""
        (
            rows.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, "digest").write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no other batch brought to the index: the same however often a batch is tried."""
        return groups.join(self.table().where(F.col("batch") != batch).hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add those groups (digest, keep_id, group_size) of a batch whose digest is new; what an earlier try of the batch
        added is in the index already and stays as it is."""
        fresh = groups.join(self.table().hint("merge"), "digest", "left_anti")
        self._write(materialise(fresh.withColumn("batch", F.lit(batch)), "index-batch"))

    def compact(self) -> None:
        """Rewrite the index with one file a bucket, so that Spark reads the buckets as sorted again after many batches.
        The old files stay until the caller clears them: a job that still reads them goes on."""
        # The files as a plain table: Spark would take a bucketed one as dealt out already and skip the shuffle.
        rows = self.spark.read.schema(self.table().schema).parquet(self.path)
        kind = self.table().schema["keep_id"].dataType.simpleString()
        new = DigestIndex(self.spark, f"{self.name}_compact", shared_path(self.spark, "digest-index"), self.buckets, kind)
        new._write(rows)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {new.name} RENAME TO {self.name}")
        self.path = new.path

    def drop(self) -> None:
        """Take the index out of the catalog; its files stay in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialise(df.select(F.col(id_col).alias("id"), digest(text_or_empty(text_col)).alias("digest")), "digests")


def _marked(rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """(id, keep_id, group_size, kept, digest): rows (id, digest) against known (digest, keep_id, group_size, n, fresh);
    n rows have the digest, fresh ones may keep a row. Of rows with the id that stays one is kept."""
    marked = join_groups(rows, known, ["digest"], "n", total=total)
    first = F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.lit(1))) == 1
    kept = F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id"))
    # Only rows that carry the largest id can be repeats of the kept one: the window sees no hot group.
    winners = marked.where(kept).withColumn("kept", first)
    losers = marked.where(~kept).withColumn("kept", F.lit(False))
    return winners.unionByName(losers)


def mark(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. In a batch the
    row with the largest id stays, unless another batch brought its digest to the index: then keep_id is the index's
    and no row of this batch stays. A batch that is tried again under its name gets the same result. A null id ranks
    below all others. Of repeated rows (same id and text) one is kept. group_size counts the rows of the batch that
    founded the group."""
    batch = batch or uuid.uuid4().hex
    rows = _digests(df, id_col, text_col)
    groups = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "digest-groups")
    index.append(groups, batch)
    # Of each digest of the batch: what the index says, and how many rows of the batch have it.
    known = index.table().join(groups.select("digest", F.col("group_size").alias("n")).hint("merge"), "digest")
    known = known.select("digest", "keep_id", "group_size", "n", (F.col("batch") == batch).alias("fresh"))
    marked = _marked(rows, known, rows.count())
    return marked.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def mark_in_batches(df: DataFrame, index: DigestIndex, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As mark() for one whole table, fed to the index in batches of descending ids (null ids last), so that a
    digest's first batch holds its largest id. A later batch adds only the digests that the anti-join with the index
    leaves; group_size counts the rows of all batches."""
    rows = _digests(df, id_col, text_col)
    edges = rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    below = [(F.col("id") <= edge).cast("int") for edge in edges]
    part = F.coalesce(sum(below, F.lit(0)), F.lit(batches - 1))
    groups = rows.groupBy(part.alias("part"), "digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "digest-groups")
    for k in range(batches):
        name = f"batch-{k}"
        index.append(groups.where(F.col("part") == k).drop("part"), name)
    sizes = groups.groupBy("digest").agg(F.sum("group_size").alias("n"))
    known = index.table().select("digest", "keep_id").join(sizes.hint("merge"), "digest").select("digest", "keep_id", F.col("n").alias("group_size"), "n", F.lit(True).alias("fresh"))
    marked = _marked(rows, known, rows.count())
    return marked.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    marked = materialise(mark_in_batches(read_table(spark, sf_dir, "documents"), index), "marked")
    index.drop()
    return marked


OP3_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
