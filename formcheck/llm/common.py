"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a batch that goes to a Python worker: whole texts are in it, so its bytes follow the texts' lengths.
BATCH_ROWS, BATCH_SETTING = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a session in one process
    gets a folder of its own; on a cluster, where nodes would each have another, it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="formcheck-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors. Batches for Python are
    small meanwhile, unless the session has a still lower setting."""
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    own = int(before)
    conf.set(BATCH_SETTING, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
    try:
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    finally:
        conf.set(BATCH_SETTING, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing will read again."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.table_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def settle(spark: SparkSession) -> None:
    """Let the driver drop what finished phases have left: Spark deletes shuffle files when their plans are collected,
    which an idle driver puts off for up to half an hour (spark.cleaner.periodicGC.interval). The scheduler holds the last
    job's plan until the next one, so a small one is run."""
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def keyed(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """df with a long key whose order is that of the ids: the id itself, or row numbers where ids are null, repeat or are
    no whole numbers. Rows of one id stand in an order of their own then; null ids come last."""
    ids = df.groupBy(id_col).count()
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and not ids.where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        return df, id_col
    return materialise(df.orderBy(F.col(id_col).asc_nulls_last()).withColumn("__fc_row", F.monotonically_increasing_id()), "rows"), "__fc_row"


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str = "n", hot: int = 200, total: int | None = None) -> DataFrame:
    """Inner join of rows with one group row per key, without a hot task: keys that hold more than 1/hot of
    all rows, so at most `hot` of them, are joined by broadcast, the others by a merge join. `size` counts the
    rows of a group, `total` all rows (default: the sum of the sizes)."""
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * hot > F.lit(total)
    rest = [c for c in groups.columns if c not in key]
    few = F.broadcast(groups.where(large).select(*key, F.struct(*rest).alias("__fc_hot")))
    tagged = rows.join(few, key, "left")
    cold = tagged.where("__fc_hot IS NULL").drop("__fc_hot").join(groups.where(~large), key)
    warm = tagged.where("__fc_hot IS NOT NULL").select(*rows.columns, *[F.col("__fc_hot")[c].alias(c) for c in rest])
    return cold.unionByName(warm)
