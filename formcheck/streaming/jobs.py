"""Structured Streaming jobs: run totals, stuck results, webhook matches, review state, activity windows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from formcheck.constants import STUCK_MINUTES
from formcheck.functions import scalars as S


#: Class of Spark's state store on local disk with snapshots in the checkpoint: state may outgrow the memory of executors.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def run_metrics(results: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Totals per run and window of time as results(rr_id, run_id, errors, warnings, passed, created_at) arrive; a repeated result
    within the watermark counts once. For update mode: a row is the window's total so far, and the state of a window ends
    with the watermark, so it is bounded by what the watermark leaves open. See run_metrics_batch and run_totals."""
    once = results.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["rr_id"])
    sums = [F.sum(c).alias(c) for c in ("errors", "warnings", "passed")]
    return once.groupBy("run_id", F.window("created_at", size).alias("w")).agg(F.count(F.lit(1)).alias("results"), *sums).select("run_id", F.col("w.start").alias("start"), "results", "errors", "warnings", "passed")


RUN_WINDOWS = "run_id long, start timestamp, results long, errors long, warnings long, passed long"


def run_metrics_batch(path: str, buckets: int = 64):
    """foreachBatch function: put the windows of a batch in place of those that the table at a path has."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return old.join(batch, ["run_id", "start"], "left_anti").unionByName(batch)

    return upsert_batch(path, RUN_WINDOWS, "run_id", merge, buckets)


def run_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals per run of the table that run_metrics_batch keeps."""
    rows = upserted(spark, path, RUN_WINDOWS)
    return rows.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("results", "errors", "warnings", "passed")])


class StuckProcessor(StatefulProcessor):
    """State of one bucket of results: of each that is open since when it runs and when it last ended, both in milliseconds of
    event time, and the earliest timer that is set. The store is asked once a bucket, not once a result."""

    def __init__(self, minutes: int):
        self.limit = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "ids array<long>, since array<long>, ended array<long>, timer long")

    def _held(self) -> tuple[dict, int | None]:
        ids, since, ended, timer = self.state.get() if self.state.exists() else ([], [], [], None)
        return dict(zip(ids, zip(since, ended, strict=True), strict=True)), timer

    def _settle(self, held: dict, timer: int | None, now: int) -> list:
        """Let go of what the watermark has passed, store the rest with a timer for the first that is due, and return the
        results that ran too long by then. A timer that is no longer needed finds nothing to do."""
        failed, rest, first = [], {}, None
        for key, (since, ended) in held.items():
            if since is not None and since + self.limit <= now:
                failed.append(key)
                since = None
            ended = ended if ended is not None and ended > now else None
            if since is not None or ended is not None:
                rest[key] = (since, ended)
                due = min(t for t in (None if since is None else since + self.limit, ended) if t is not None)
                first = due if first is None else min(first, due)
        if not rest:
            self.state.clear()
            return failed
        if timer is None or timer <= now or first < timer:
            timer = first
            self.handle.registerTimer(timer)
        since, ended = zip(*rest.values(), strict=True)
        self.state.update((list(rest), list(since), list(ended), timer))
        return failed

    @staticmethod
    def _rows(failed) -> Iterator[pd.DataFrame]:
        if failed:
            yield pd.DataFrame({"rr_id": pd.array(list(failed), dtype="Int64"), "status": "failed"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        failed: dict = {}
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        times = events["at"].astype("datetime64[ms]").astype("int64").tolist()
        for id_, known, at, running in zip(events["rr_id"].tolist(), events["known"].tolist(), times, events["running"].tolist(), strict=True):
            rr_id = id_ if known else None
            since, ended = held.get(rr_id, (None, None))
            if running:
                # A start that arrives after its end is over already.
                if ended is None or at > ended:
                    since = at if since is None else min(since, at)
                elif ended > at + self.limit:
                    failed[rr_id] = True
            else:
                if since is not None and since <= at:
                    if at > since + self.limit:
                        failed[rr_id] = True
                    since = None
                ended = at if ended is None else max(ended, at)
            held[rr_id] = (since, ended)
        # One row of a result, though it may have failed more than once here.
        yield from self._rows(failed | dict.fromkeys(self._settle(held, timer, timerValues.getCurrentWatermarkInMs())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._rows(self._settle(*self._held(), timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def stuck_results(events: DataFrame, minutes: int = STUCK_MINUTES, late: str = "1 minute", buckets: int = 1024) -> DataFrame:
    """events(rr_id, state running|other, at): rows (rr_id, status failed) for results that run for longer than the limit
    in event time: when the watermark passes the limit, or when an end arrives that lies beyond it. An end may arrive before
    its start; of a result that runs again, an earlier run's start must not arrive after a later one's end. State is two timestamps of a result and goes with its timers; it needs the ROCKSDB store (see start).
    Results are kept in `buckets` by a hash of their number, which must stay what it was when the stream was begun."""
    rr_id = F.col("rr_id").cast("long")
    # A missing number is a result of its own; it travels apart, so that the others stay whole numbers.
    known = events.select(F.pmod(F.xxhash64(rr_id), F.lit(buckets)).alias("bucket"), F.coalesce(rr_id, F.lit(0)).alias("rr_id"), rr_id.isNotNull().alias("known"), F.coalesce(F.col("state") == "running", F.lit(False)).alias("running"), "at")
    marked = known.withWatermark("at", late).groupBy("bucket")
    return marked.transformWithStateInPandas(StuckProcessor(minutes), "rr_id long, status string", "append", "EventTime")


def webhook_matches(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Stream of events joined with the static endpoints of their project that list the event."""
    own = hooks.where("is_active").select("hook_id", "project_id", "url", S.csv_tokens(F.col("events")).alias("names"))
    return events.join(own, "project_id").where(F.array_contains("names", F.col("action"))).select("id", "hook_id", "url", "action")


def activity_windows(audit: DataFrame, size: str = "7 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Audit rows per window and action; later rows than the watermark are dropped."""
    window = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    counted = audit.withWatermark("created_at", late).groupBy(window.alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "action", "n")


REVIEWS = "rr_id long, finding_index long, status string, issue_key string"
VERDICTS = "rr_id long, run_id long, errors long, warnings long, status string, passed int"


def upserted(spark: SparkSession, path: str, schema: str, table: str = "rows") -> DataFrame:
    """The table that upsert_batch keeps at a path; empty before the first batch."""
    where, whole = f"{path}/{table}", f"{schema}, bucket int"
    return spark.read.schema(whole).parquet(where) if _exists(spark, where) else spark.createDataFrame([], whole)


def upsert_batch(path: str, schema: str, key: str, merge, buckets: int = 64, table: str = "rows", after=None):
    """foreachBatch function: the table at a path becomes merge(old rows, batch). The table is split by a hash of `key`, and a
    batch writes only the buckets that it touches: first beside the table, then over them. A batch that failed is
    tried again from what it had written whole, so no bucket is lost; a repeated batch changes nothing. A path belongs
    to one stream with its checkpoint. `buckets` must stay what it was when the table was begun; at most that many
    numbers reach the driver. after(spark, numbers of the touched buckets) is called when the table is written."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, staged = batch.sparkSession, f"{path}/batches/{batch_id}"
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        if not _exists(spark, f"{staged}/_SUCCESS"):
            touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
            old = upserted(spark, path, schema, table).where(F.col("bucket").isin(touched)).drop("bucket")
            merged = merge(old, batch).withColumn("bucket", bucket)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
        rows = spark.read.schema(f"{schema}, bucket int").parquet(staged)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{table}")
        if after:
            after(spark, [r.bucket for r in rows.select("bucket").distinct().collect()])
        _delete(spark, f"{path}/batches/{batch_id - 1}")

    return step


def review_actions(actions: DataFrame, late: str = "1 day") -> DataFrame:
    """actions(action_id, rr_id, finding_index, action, issue_key, action_at timestamp), each once: an action that is
    delivered again within the watermark is dropped, across batches and restarts."""
    return actions.withWatermark("action_at", late).dropDuplicatesWithinWatermark(["action_id"])


def review_state(spark: SparkSession, path: str) -> DataFrame:
    """The review table that review_state_batch keeps at a path; empty before the first batch."""
    return upserted(spark, path, REVIEWS, "reviews")


def verdict_state(spark: SparkSession, path: str) -> DataFrame:
    """Errors, warnings and status of the reviewed results that review_state_batch keeps beside the reviews."""
    return upserted(spark, path, VERDICTS, "verdicts")


def review_state_batch(path: str, buckets: int = 64, findings: DataFrame | None = None, results: DataFrame | None = None):
    """foreachBatch function: merge a batch of review actions into the review table at a path (see upsert_batch). With findings
    and results, the verdicts of the results in the touched buckets follow: they are taken anew from the reviews that
    stand there, so a batch that is tried again gives the same."""
    from formcheck.operators.reviews import recompute_after_review, upsert_reviews

    def judge(spark: SparkSession, touched: list[int]) -> None:
        own = review_state(spark, path).where(F.col("bucket").isin(touched))
        keys = own.select("rr_id", "bucket").distinct()
        part = lambda df: df.join(keys.select("rr_id"), "rr_id", "left_semi")
        rows = recompute_after_review(part(findings), own.drop("bucket"), part(results)).join(keys, "rr_id")
        rows = rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in VERDICTS.split(", ")), "bucket")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/verdicts")

    return upsert_batch(path, REVIEWS, "rr_id", upsert_reviews, buckets, "reviews", judge if findings is not None else None)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def start(stream: DataFrame, path: str, mode: str = "append", batch=None) -> StreamingQuery:
    """Start a stream over all that is there, with its checkpoint below a path and its state in the ROCKSDB store. Appended rows
    go to `{path}/rows`, a complete table in place of the last one; `batch` is a foreachBatch function instead."""
    conf = stream.sparkSession.conf
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if batch is None and mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/rows")
    else:
        writer = writer.foreachBatch(batch or (lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows")))
    before = conf.get(STORE)
    conf.set(STORE, ROCKSDB)
    try:
        # A query keeps the settings of its start.
        return writer.start()
    finally:
        conf.set(STORE, before)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote: appended rows, or the last complete table."""
    start(stream, path, mode).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the one that spark.checkpoint.dir names; an own one where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="formcheck-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
