"""Sources and sinks: tables, form files, manifests, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_BYTES = 50 * 1024 * 1024
FORMS_PER_PROJECT = 10
MODES = ["basic", "specific", "benchmark"]


def read_tables(spark: SparkSession, source: str, schemas: dict[str, StructType | str], keys: dict[str, str] | None = None, parts: int = 16, options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of a source, each with its declared schema: nothing is inferred. A source is a folder of Parquet files or, where it
    begins with `jdbc:`, a database: see read_jdbc."""
    if source.startswith("jdbc:"):
        return {name: read_jdbc(spark, source, name, schema, (keys or {}).get(name), parts, options) for name, schema in schemas.items()}
    return {name: spark.read.schema(schema).parquet(f"{source}/{name}.parquet") for name, schema in schemas.items()}


def read_jdbc(spark: SparkSession, url: str, table: str, schema: StructType | str, key: str | None = None, parts: int = 16, options: dict[str, str] | None = None) -> DataFrame:
    """A database table with the declared columns and types. With a numeric or date `key` it is read in `parts` ranges of the
    key at a time, between the bounds that the database gives (one row); a null key is in the first. Filters and the
    choice of columns are the database's work. Without a key, or where the table is empty, one task reads all."""
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    reader = lambda **told: spark.read.format("jdbc").options(**{"url": url} | (options or {}) | told).load()
    columns = ", ".join(f.name for f in declared)
    told = {"dbtable": f"(SELECT {columns} FROM {table}) told", "customSchema": declared.toDDL(), "fetchsize": "10000"}
    if key:
        low, high = reader(query=f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}").first()
        if low is not None:
            told |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    # A database may tell names in another case.
    return reader(**told).toDF(*declared.names)


def ingest_form_files(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """files(path, length, content) as read by binaryFile: every file with a reject reason, null where accepted."""
    reason = F.when(~F.lower("path").endswith(".pdf"), "not a .pdf file").when(F.col("length") > most, "too large").when(F.coalesce(F.substring("content", 1, 4) != F.lit(b"%PDF"), F.lit(True)), "content is no PDF")
    return files.select("path", "length", reason.alias("reason"))


def assign_stored_names(uploads: DataFrame, existing: DataFrame, most: int = FORMS_PER_PROJECT) -> DataFrame:
    """uploads(project_id, upload_no, base, extension): stored names with suffixes _1, _2, ... for repeated names, at
    most ten forms in a project counting those in existing(project_id, base); the others are skipped."""
    held = existing.groupBy("project_id", "base").agg(F.count(F.lit(1)).alias("held"))
    total = existing.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    rows = uploads.join(held, ["project_id", "base"], "left").join(total, "project_id", "left").fillna(0, ["held", "total"])
    place = F.col("total") + F.row_number().over(Window.partitionBy("project_id").orderBy("upload_no"))
    rows = rows.withColumn("place", place)
    nth = F.col("held") + F.row_number().over(Window.partitionBy("project_id", "base").orderBy("upload_no")) - 1
    suffix = F.when(nth > 0, F.concat(F.lit("_"), nth.cast("string"))).otherwise("")
    kept = rows.where(F.col("place") <= most).withColumn("suffix", suffix)
    return kept.select("project_id", "upload_no", F.concat("base", "suffix", "extension").alias("stored_name"))


def validate_manifest(tests: DataFrame) -> DataFrame:
    """tests(test_no, name, current, benchmark, mode, prompt): defaults filled in, and a reason per bad row."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    mode = F.lower(F.coalesce(F.nullif(F.trim("mode"), F.lit("")), F.lit("basic")))
    reason = F.when(~mode.isin(MODES), F.concat(F.lit("unknown mode "), mode)).when(blank("current"), "current is missing").when((mode == "benchmark") & blank("benchmark"), "benchmark is missing")
    name = F.when(blank("name"), F.concat(F.lit("Test "), F.col("test_no").cast("string"))).otherwise(F.col("name"))
    return tests.select("test_no", name.alias("name"), mode.alias("mode"), F.coalesce("prompt", F.lit("")).alias("prompt"), reason.alias("reason"))


def replace_field_inventory(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """Inventory with all rows of rescanned forms replaced."""
    return old.join(scanned.select("form_id").distinct(), "form_id", "left_anti").unionByName(scanned, allowMissingColumns=True)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_audit_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
