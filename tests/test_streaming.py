"""Streams give what the batch gives; a late or missing end of a result is noticed."""

import shutil
from datetime import datetime, timedelta

from formcheck.operators.reviews import upsert_reviews
from formcheck.streaming import jobs

T0 = datetime(2024, 1, 1, 10, 0)


def test_stuck_results(spark, tmp_path):
    schema = "rr_id long, state string, at timestamp"
    batches = [
        [(1, "running", T0), (2, "running", T0)],
        [(1, "done", T0 + timedelta(minutes=10)), (3, "running", T0 + timedelta(minutes=29))],
        [(4, "running", T0 + timedelta(minutes=31))],
        [(4, "done", T0 + timedelta(minutes=32))],
    ]
    source = str(tmp_path / "in")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b={n}")
    stream = spark.readStream.schema(f"{schema}, b int").option("maxFilesPerTrigger", 1).parquet(source).drop("b")
    out = jobs.drain(jobs.stuck_results(stream), str(tmp_path / "out")).collect()
    assert [(r.rr_id, r.status) for r in out] == [(2, "failed")]


def feed(spark, source, schema, batches, begin=0):
    """Each batch is a file of its own; the stream takes one at a time."""
    for n, rows in enumerate(batches, begin):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b={n}")
    return spark.readStream.schema(f"{schema}, b int").option("maxFilesPerTrigger", 1).parquet(source).drop("b")


def test_stuck_results_over_a_restart(spark, tmp_path):
    """The stream stops while timers run; an end before its start, a late end and a watermark that passes the limit."""
    schema, source, out = "rr_id long, state string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda m: T0 + timedelta(minutes=m)
    first = [[(1, "running", at(0)), (2, "running", at(0)), (3, "done", at(5)), (6, "running", at(-3))], [(3, "running", at(4)), (6, "done", at(12))]]
    jobs.drain(jobs.stuck_results(feed(spark, source, schema, first)), out)
    assert spark.read.parquet(f"{out}/rows").count() == 0
    second = [[(2, "done", at(14)), (4, "running", at(14))], [(5, "running", at(17))], [(4, "done", at(40))]]
    rows = jobs.drain(jobs.stuck_results(feed(spark, source, schema, second, 2)), out).collect()
    assert sorted(r.rr_id for r in rows) == [1, 4, 5]
    # Nothing that was told is told again, and no state stays of what is over.
    third = [[(9, "running", at(400))], [(9, "done", at(401))], [(10, "done", at(500))], [(11, "done", at(501))]]
    query = jobs.start(jobs.stuck_results(feed(spark, source, schema, third, 5)), out)
    query.awaitTermination()
    assert spark.read.parquet(f"{out}/rows").count() == 3
    state = spark.read.format("statestore").option("stateVarName", "run").load(f"{out}/checkpoint").count()
    assert state <= 2


def test_run_metrics_state_ends_with_the_watermark(spark, tmp_path):
    schema, source, path = "rr_id long, run_id long, errors long, warnings long, passed long, created_at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, rr: (rr, rr % 3, 1, 2, 0, T0 + timedelta(days=d))
    run = lambda stream: jobs.start(jobs.run_metrics(stream), path, "update", jobs.run_metrics_batch(path, 4))
    query = run(feed(spark, source, schema, [[day(d, 10 * d + k) for k in range(6)] for d in range(5)]))
    query.awaitTermination()
    held = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators if "dedupe" not in op.operatorName.lower()]
    # From the second day on no more state is held: a day's state ends when the next day has come.
    assert len(held) > 4 and max(held[2:]) <= held[1]
    totals = lambda: {r.run_id: (r.results, r.errors, r.warnings) for r in jobs.run_totals(spark, path).collect()}
    assert totals() == {0: (10, 10, 20), 1: (10, 10, 20), 2: (10, 10, 20)}
    # A result that comes again after a restart, within the watermark, and a new one of a window that is still open.
    run(feed(spark, source, schema, [[day(4, 40), day(4, 99)]], 5)).awaitTermination()
    assert totals() == {0: (11, 11, 22), 1: (10, 10, 20), 2: (10, 10, 20)}


def test_review_actions_once_over_a_restart(spark, tmp_path):
    """The action that is delivered again after a restart changes nothing, though a later one came between."""
    schema, source, path = "action_id long, rr_id long, finding_index long, action string, issue_key string, action_at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    findings = spark.createDataFrame([(1, "spelling_errors", 0, True), (1, "format_issues", 0, True), (2, "spelling_errors", 0, True)], "rr_id long, bucket string, bucket_pos int, is_object boolean")
    results = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "rr_id long, run_id long")
    run = lambda stream: jobs.start(jobs.review_actions(stream), path, "append", jobs.review_state_batch(path, 4, findings, results)).awaitTermination()
    at = lambda h: T0 + timedelta(hours=h)
    run(feed(spark, source, schema, [[(1, 1, 0, "resolved", "K-1", at(0)), (2, 2, 0, "false_positive", None, at(0))], [(3, 1, 0, "assign", None, at(1))]]))
    verdicts = lambda: {r.rr_id: (r.run_id, r.errors, r.warnings, r.status) for r in jobs.verdict_state(spark, path).collect()}
    assert verdicts() == {1: (7, 0, 2, "in_review"), 2: (7, 0, 0, "passed")}
    again = [[(1, 1, 0, "resolved", "K-1", at(0)), (4, 1, 1, "resolved", "K-2", at(2))]]
    run(feed(spark, source, schema, again, 2))
    state = {(r.rr_id, r.finding_index): (r.status, r.issue_key) for r in jobs.review_state(spark, path).collect()}
    assert state == {(1, 0): ("in_review", "K-1"), (1, 1): ("resolved", "K-2"), (2, 0): ("false_positive", None)}
    assert verdicts() == {1: (7, 1, 1, "in_review"), 2: (7, 0, 0, "passed")}


def test_review_state(spark, tmp_path):
    schema = "rr_id long, finding_index long, action string, issue_key string, action_at long"
    first = spark.createDataFrame([(1, 0, "assign", None, 1), (1, 0, "false_positive", "K-1", 2), (2, 0, "closed", None, 1)], schema)
    second = spark.createDataFrame([(1, 0, "open", None, 3)], schema)
    merge = jobs.review_state_batch(str(tmp_path))
    merge(first, 0)
    merge(second, 1)
    state = lambda: {(r.rr_id, r.finding_index): (r.status, r.issue_key) for r in jobs.review_state(spark, str(tmp_path)).collect()}
    assert state() == {(1, 0): ("open", "K-1"), (2, 0): ("resolved", None)}
    # A batch that broke off after it was staged, with a bucket already removed, is finished from what it staged.
    merge(spark.createDataFrame([(2, 0, "open", None, 4)], schema), 2)
    for r in jobs.review_state(spark, str(tmp_path)).where("rr_id = 2").select("bucket").collect():
        shutil.rmtree(f"{tmp_path}/reviews/bucket={r.bucket}")
    merge(spark.createDataFrame([(2, 0, "open", None, 4)], schema), 2)
    assert state() == {(1, 0): ("open", "K-1"), (2, 0): ("open", None)}
    merge(first.where("rr_id > 9"), 3)
    assert len(state()) == 2
    empty = spark.createDataFrame([], "rr_id long, finding_index long, status string, issue_key string")
    assert upsert_reviews(empty, first).count() == 2


def test_stuck_results_keep_one_state_a_bucket(spark, tmp_path):
    """Results share the state of their bucket, and each is judged by its own events; a missing number is one of its own."""
    schema, source, out = "rr_id long, state string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda m: T0 + timedelta(minutes=m)
    big = 2**53 + 1
    first = [[(k, "running", at(k % 10)) for k in range(200)] + [(big, "running", at(0)), (None, "running", at(1)), (0, "running", at(0))]]
    # Every third ends in time, every fifth of the others too late and before the watermark tells.
    second = [[(k, "done", at(k % 10 + 15)) for k in range(0, 200, 3)] + [(k, "done", at(k % 10 + 16)) for k in range(200) if k % 3 and k % 5 == 0]]
    run = lambda batches, n: jobs.drain(jobs.stuck_results(feed(spark, source, schema, batches, n), buckets=4), out)
    assert run(first, 0).count() == 0
    assert spark.read.format("statestore").option("stateVarName", "run").load(f"{out}/checkpoint").count() <= 4
    run(second, 1)
    rows = run([[(999, "done", at(60))], [(999, "done", at(61))]], 2).collect()
    assert all(r.status == "failed" for r in rows)
    told = [r.rr_id for r in rows]
    assert sorted(told, key=lambda k: -1 if k is None else k) == [None, *(k for k in range(200) if k % 3), big]
    assert spark.read.format("statestore").option("stateVarName", "run").load(f"{out}/checkpoint").count() <= 1
