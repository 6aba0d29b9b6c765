"""Streaming jobs run over the driver tables as files, and what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formcheck.plans import sqltext as Q
from formcheck.plans.registry import query
from formcheck.plans.report_queries import _HOOKS
from formcheck.sources.fixtures import FX_AUDIT, Tables
from formcheck.streaming import jobs


def audit_stream(t: Tables) -> DataFrame:
    """The audit table as a stream: its files below the directory of the tables."""
    events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return t.spark.sql(FX_AUDIT, events=events).withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("stream_activity_windows", "SELECT time_bucket(INTERVAL 1 DAY, created_at) AS start, action, count(*) AS n FROM {fx_audit} GROUP BY ALL")
def stream_activity_windows(t: Tables) -> DataFrame:
    return jobs.drain(jobs.activity_windows(audit_stream(t), "1 day"), jobs.work_dir(t.spark, "activity"), "complete")


@query("stream_webhook_matches", f"SELECT id, hook_id, url, action FROM {{fx_audit}} a JOIN ({_HOOKS}) h ON a.project_id = h.project_id WHERE is_active AND list_contains(list_transform(string_split(events, ','), lambda x: trim(x)), action)")
def stream_webhook_matches(t: Tables) -> DataFrame:
    return jobs.drain(jobs.webhook_matches(audit_stream(t), t.spark.sql(_HOOKS, customer=t.customer)), jobs.work_dir(t.spark, "webhooks"))


@query("stream_run_metrics", "SELECT project_id % 7 AS run_id, count(*) AS results, CAST(sum(id % 3) AS BIGINT) AS errors, CAST(sum(id % 2) AS BIGINT) AS warnings, CAST(sum(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM {fx_audit} GROUP BY 1")
def stream_run_metrics(t: Tables) -> DataFrame:
    rows = audit_stream(t).selectExpr("id AS rr_id", "project_id % 7 AS run_id", "id % 3 AS errors", "id % 2 AS warnings", "CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS passed", "created_at")
    path = jobs.work_dir(t.spark, "run-metrics")
    jobs.start(jobs.run_metrics(rows), path, "update", jobs.run_metrics_batch(path)).awaitTermination()
    return jobs.run_totals(t.spark, path)


#: Results that run between two events of the table; of some the end is missing.
_RUNNING = "SELECT id - id % 8 + id % 4 AS rr_id, CASE WHEN id % 8 < 4 THEN 'running' ELSE 'done' END AS state, created_at AS seen FROM {fx_audit} WHERE id % 8 < 4 OR id % 7 <> 0"


@query("stream_stuck_results", f"""
WITH e AS ({_RUNNING}), r AS (SELECT rr_id, min(CASE WHEN state = 'running' THEN seen END) AS since, min(CASE WHEN state = 'done' THEN seen END) AS ended FROM e GROUP BY rr_id)
SELECT rr_id, 'failed' AS status FROM r
WHERE since IS NOT NULL AND CASE WHEN ended IS NULL THEN date_trunc('milliseconds', since) + INTERVAL 15 MINUTE <= (SELECT max(date_trunc('milliseconds', seen)) FROM e) - INTERVAL 1 MINUTE ELSE date_trunc('milliseconds', ended) > date_trunc('milliseconds', since) + INTERVAL 15 MINUTE END""")
def stream_stuck_results(t: Tables) -> DataFrame:
    rows = t.spark.sql(_RUNNING, fx_audit=audit_stream(t)).withColumnRenamed("seen", "at")
    return jobs.drain(jobs.stuck_results(rows), jobs.work_dir(t.spark, "stuck"))


_ACTIONS = """SELECT id AS action_id, id % 2000 AS rr_id, CAST(id % 3 AS INT) AS finding_index,
  CASE id % 4 WHEN 0 THEN 'assign' WHEN 1 THEN 'resolved' WHEN 2 THEN 'false_positive' ELSE 'open' END AS action,
  CASE WHEN id % 5 = 0 THEN concat('K-', CAST(id % 97 AS STRING)) ELSE NULL END AS issue_key, created_at AS action_at FROM {fx_audit}"""


@query("stream_review_state", f"""
WITH l AS (SELECT rr_id, finding_index, CASE arg_max(action, action_at) WHEN 'assign' THEN 'in_review' ELSE arg_max(action, action_at) END AS status FROM ({_ACTIONS}) a GROUP BY rr_id, finding_index),
j AS (SELECT n.rr_id, coalesce(l.status, 'open') AS status FROM ({Q.NUMBERED}) n LEFT JOIN l ON n.rr_id = l.rr_id AND n.finding_index = l.finding_index),
s AS (SELECT rr_id, count(*) FILTER (WHERE status = 'resolved') AS e, count(*) FILTER (WHERE status NOT IN ('resolved', 'false_positive')) AS w FROM j GROUP BY rr_id)
SELECT r.rr_id, run_id, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, CASE WHEN coalesce(w, 0) > 0 THEN 'in_review' WHEN coalesce(e, 0) > 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN coalesce(w, 0) = 0 AND coalesce(e, 0) = 0 THEN 1 ELSE 0 END AS passed
FROM {{fx_results}} r LEFT JOIN s ON r.rr_id = s.rr_id WHERE r.rr_id IN (SELECT rr_id FROM l)""")
def stream_review_state(t: Tables) -> DataFrame:
    """Each action is delivered twice."""
    actions = t.spark.sql(_ACTIONS, fx_audit=audit_stream(t).unionByName(audit_stream(t)))
    path = jobs.work_dir(t.spark, "reviews")
    jobs.start(jobs.review_actions(actions), path, "append", jobs.review_state_batch(path, findings=t.fx_findings, results=t.fx_results)).awaitTermination()
    return jobs.verdict_state(t.spark, path).drop("bucket")
