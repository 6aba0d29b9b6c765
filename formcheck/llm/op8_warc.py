"""Content-addressed WARC archive.

Method: two tables. `payloads` keeps the bytes of each distinct payload once, under a strong digest
(SHA-256) that is verified on reading; `records` keeps the exact header bytes of every record. Original
records come back through a join on the digest. Only digests are shuffled to find equal payloads; the
bytes move when the first copies are stored and when records are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.common import materialise, read_table, shared_path, text_or_empty

#: Digests that hold more than 1/HOT of all rows each, so at most HOT of them, are joined by broadcast.
HOT = 200
CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of 160-bit hexadecimal digests: ten hexadecimal digits are eight of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(record_type: Column, id_: Column, url: Column, date: str, digest: Column, size: Column, refers_to: Column, refers_url: Column) -> Column:
    """Header block of one record, up to and with the empty line."""
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    clean = lambda x: F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"[\r\n]", " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), urn(id_)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(record_type == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(record_type == "revisit", F.concat(F.lit("WARC-Refers-To: "), urn(refers_to))),
        F.when(record_type == "revisit", F.concat(F.lit("WARC-Refers-To-Target-URI: "), clean(refers_url))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(record_type == "revisit", F.lit("0")).otherwise(size.cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = 0) -> None:
    """Write records/ and payloads/ below path, one record per row.

    Among equal payloads of at least `least` bytes the row with the smallest id is the response, the others
    revisit it; smaller payloads are all responses. A null payload is empty, a null url an empty one; a null
    id ranks last. Of repeated rows with the smallest id all are responses (the payload is stored once)."""
    payload = F.encode(text_or_empty(payload_col), "UTF-8")
    sums = materialise(
        df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("sha256"), base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("size")),
        "warc-sums",
    )
    least_id = F.min_by(F.struct("id", "url"), F.struct(F.col("id").isNull(), "id", "url"))
    groups = sums.groupBy("sha256").agg(least_id.alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups, "warc-groups")
    total = sums.count()
    hot = groups.where(F.col("n") * HOT > total)
    rest = groups.where(F.col("n") * HOT <= total)
    tagged = sums.join(F.broadcast(hot.select("sha256", F.col("first").alias("hot"))), "sha256", "left")
    joined = tagged.where("hot IS NULL").drop("hot").join(rest.select("sha256", "first"), "sha256").unionByName(tagged.where("hot IS NOT NULL").withColumnRenamed("hot", "first"))
    kind = F.when((F.col("size") < least) | F.col("id").eqNullSafe(F.col("first.id")), "response").otherwise("revisit")
    refers = F.when(F.col("kind") == "revisit", F.col("first.id"))
    records = joined.withColumn("kind", kind).select("id", "sha256", _header(F.col("kind"), F.col("id"), F.col("url"), date, F.col("sha1"), F.col("size"), refers, F.col("first.url")).alias("header"))
    records.write.parquet(f"{path}/records")
    # The bytes of the first copies. One key serves join and dropDuplicates, so the bytes are shuffled once
    # and a repeated first row is stored once.
    key = lambda sha, id_: F.concat(sha, F.lit(":"), F.coalesce(id_.cast("string"), F.lit("null")))
    firsts = groups.select(key(F.col("sha256"), F.col("first.id")).alias("key"))
    bodies = df.select(F.col(id_col).alias("id"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256)).withColumn("key", key(F.col("sha256"), F.col("id")))
    bodies.join(firsts, "key", "left_semi").dropDuplicates(["key"]).select("sha256", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the records: header bytes, content (null for a revisit) and size and sha1 of the full payload,
    both taken anew from the stored bytes. A payload whose bytes do not give its digest raises."""
    records = spark.read.parquet(f"{path}/records").withColumn("kind", _field("WARC-Type"))
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    payloads = stored.select("sha256", sound.alias("content")).withColumn("size", F.octet_length("content").cast("long")).withColumn("sha1", F.sha1("content"))
    # Responses need the bytes; a digest has one of them, save for repeated rows and payloads too small to be shared.
    responses = records.where("kind = 'response'").join(payloads, "sha256")
    # Revisits need size and sum alone; those of hot digests, at most HOT rows, go by broadcast.
    revisits = records.where("kind = 'revisit'")
    counts = revisits.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    total = records.count()
    sums = materialise(payloads.drop("content").join(counts, "sha256"), "warc-revisited")
    hot = sums.where(F.col("n") * HOT > total).select("sha256", F.struct("size", "sha1").alias("hot"))
    tagged = revisits.join(F.broadcast(hot), "sha256", "left")
    cold = tagged.where("hot IS NULL").drop("hot").join(sums.where(F.col("n") * HOT <= total).select("sha256", "size", "sha1"), "sha256")
    warm = tagged.where("hot IS NOT NULL").select("*", "hot.size", "hot.sha1").drop("hot")
    rebuilt = responses.unionByName(cold.unionByName(warm).withColumn("content", F.lit(None).cast("binary")))
    return rebuilt.select("header", "content", "size", "sha1")


def _field(name: str) -> Column:
    """A header field, from the header bytes; null where absent. Lines end with LF alone (d), not with what else Java takes
    for an end of line."""
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"(?md)^{name}: ([^\r\n]*)", 1), F.lit(""))


def archive_summary(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = read_archive(spark, path)
    ids = lambda name: F.regexp_extract(_field(name), "<urn:page:(.*)>", 1).try_cast(id_type)
    return records.select(
        ids("WARC-Record-ID").alias("page_id"), F.col("size").alias("payload_bytes"), base32(F.col("sha1")).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), ids("WARC-Refers-To").alias("refers_to"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    return archive_summary(spark, path)


_BASE32 = " || ".join(f"lpad(to_base(('0x' || substr(sha1, {10 * k + 1}, 10))::BIGINT, 32), 8, '0')" for k in range(4))
OP8_SQL = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha1 FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM t)
SELECT page_id, strlen(html) AS payload_bytes,
       translate(upper({_BASE32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
