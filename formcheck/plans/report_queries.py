"""Queries of the reporting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formcheck.operators import findings as FO
from formcheck.operators import reports as O
from formcheck.plans import sqltext as Q
from formcheck.plans.registry import query
from formcheck.sources.fixtures import Tables

#: The moment at which the reports are drawn up.
NOW = "1998-08-02 12:00:00"
LATEST = "SELECT test_case_id, max(rr_id) AS rr_id, arg_max(created_at, rr_id) AS created_at, arg_max(project_id, rr_id) AS project_id FROM {fx_results} GROUP BY test_case_id"
TOTALS = f"SELECT r.run_id, min(project_id) AS project_id, max(created_at) AS created_at, count(*) AS total, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(passed) AS BIGINT) AS passed, CASE WHEN bool_or(run_state = 'running') THEN 'running' ELSE 'completed' END AS status FROM {{fx_results}} r JOIN ({Q.METRICS}) m ON r.rr_id = m.rr_id GROUP BY r.run_id"
KEYS = "SELECT test_case_id, string_agg(DISTINCT issue_key, ',' ORDER BY issue_key) AS keys FROM {fx_reviews} v JOIN {fx_results} r ON v.rr_id = r.rr_id WHERE issue_key IS NOT NULL GROUP BY test_case_id"
SUMMARY = f"""SELECT l.test_case_id, l.project_id, l.rr_id, status, coalesce(p, 0) AS passed_findings, coalesce(d, 0) AS defects, errors + warnings AS pending, errors + warnings + coalesce(p, 0) + coalesce(d, 0) AS total, coalesce(keys, '') AS keys
FROM ({LATEST}) l JOIN ({Q.STATUS}) s ON l.rr_id = s.rr_id
LEFT JOIN (SELECT rr_id, count(*) FILTER (WHERE status = 'false_positive') AS p, count(*) FILTER (WHERE status = 'resolved') AS d FROM {{fx_reviews}} GROUP BY rr_id) c ON l.rr_id = c.rr_id
LEFT JOIN ({KEYS}) k ON l.test_case_id = k.test_case_id"""


def metrics(t: Tables) -> DataFrame:
    return FO.result_status(FO.derive_metrics(t.fx_findings, t.fx_results))


def run_totals(t: Tables) -> DataFrame:
    rows = t.fx_results.join(metrics(t).select("rr_id", "errors", "passed"), "rr_id")
    return rows.groupBy("run_id").agg(
        F.min("project_id").alias("project_id"), F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("total"), F.sum("errors").alias("errors"), F.sum("passed").alias("passed"),
        F.when(F.bool_or(F.col("run_state") == "running"), "running").otherwise("completed").alias("status"),
    )


def now() -> F.Column:
    return F.to_timestamp(F.lit(NOW))


@query("visible_projects", "SELECT project_id, name FROM {fx_projects} p WHERE EXISTS (SELECT 1 FROM {fx_members} m WHERE m.project_id = p.project_id AND user_id = 7)")
def visible_projects(t: Tables) -> DataFrame:
    return O.visible_projects(t.fx_projects, t.fx_members, 7, False).select("project_id", "name")


@query("active_reviewers", "SELECT DISTINCT user_id, role FROM {fx_members} WHERE role IN ('admin', 'reviewer')")
def active_reviewers(t: Tables) -> DataFrame:
    return O.active_reviewers(t.fx_members)


@query("members_by_project", "SELECT project_id, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',') AS users FROM {fx_members} GROUP BY project_id")
def members_by_project(t: Tables) -> DataFrame:
    return O.members_by_project(t.fx_projects, t.fx_members).select("project_id", F.array_join("users", ",").alias("users"))


@query("runs_since", f"SELECT count(*) AS runs FROM {{fx_runs}} WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def runs_since(t: Tables) -> DataFrame:
    return O.runs_since(t.fx_runs, now())


@query("expire_stuck_results", f"SELECT rr_id, CASE WHEN s THEN 'failed' ELSE run_state END AS run_state, CASE WHEN s THEN 'no result after 15 minutes' END AS error_message FROM (SELECT *, run_state = 'running' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE AS s FROM {{fx_results}}) x")
def expire_stuck_results(t: Tables) -> DataFrame:
    return O.expire_stuck_results(t.fx_results, now())


@query("rerun_candidates", "SELECT DISTINCT run_id, test_case_id FROM {fx_results} WHERE run_state IN ('failed', 'error')")
def rerun_candidates(t: Tables) -> DataFrame:
    return O.rerun_candidates(t.fx_results, ["failed", "error"])


_SCHEDULES = "SELECT o_custkey AS schedule_id, o_custkey AS project_id, o_custkey % 3 <> 0 AS is_active, max(CAST(o_orderdate AS TIMESTAMP)) AS next_run_at, concat(CAST(o_custkey * 4 AS STRING), ' , x, ', CAST(o_custkey * 4 + 1 AS STRING), ',,', CAST(o_custkey * 4 + 9 AS STRING)) AS testcase_ids FROM {orders} GROUP BY o_custkey"


@query("due_schedules", f"""
SELECT s.schedule_id, s.project_id, s.test_case_id FROM (SELECT schedule_id, project_id, TRY_CAST(trim(unnest(string_split(testcase_ids, ','))) AS BIGINT) AS test_case_id FROM ({_SCHEDULES}) q WHERE is_active AND next_run_at <= TIMESTAMP '{NOW}') s
JOIN (SELECT DISTINCT test_case_id, project_id FROM {{fx_results}}) c ON s.test_case_id = c.test_case_id AND s.project_id = c.project_id""")
def due_schedules(t: Tables) -> DataFrame:
    return O.due_schedules(t.spark.sql(_SCHEDULES, orders=t.orders), t.fx_results.select("test_case_id", "project_id").distinct(), now())


_HOOKS = "SELECT c_custkey AS hook_id, c_custkey AS project_id, concat('https://hook.example.com/', CAST(c_custkey AS STRING)) AS url, CASE c_custkey % 3 WHEN 0 THEN 'finding.click, finding.view' WHEN 1 THEN 'finding.purchase' ELSE ' finding.signup ,finding.click' END AS events, c_custkey % 4 <> 0 AS is_active FROM {customer}"


@query("match_webhooks", f"SELECT id, hook_id, url, action FROM {{fx_audit}} a JOIN ({_HOOKS}) h ON a.project_id = h.project_id WHERE is_active AND list_contains(list_transform(string_split(events, ','), lambda x: trim(x)), action)")
def match_webhooks(t: Tables) -> DataFrame:
    return O.match_webhooks(t.fx_audit, t.spark.sql(_HOOKS, customer=t.customer)).drop("payload")


@query("last_run_per_project", "SELECT p.project_id, run_id AS last_run_id, status AS last_status FROM {fx_projects} p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) AS n FROM {fx_runs}) r ON p.project_id = r.project_id AND n = 1")
def last_run_per_project(t: Tables) -> DataFrame:
    return O.last_run_per_project(t.fx_projects, t.fx_runs)


@query("latest_result_per_test_case", LATEST)
def latest_result_per_test_case(t: Tables) -> DataFrame:
    return O.latest_result_per_test_case(t.fx_results)


@query("recent_runs", "SELECT project_id, run_id, n AS nth FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) AS n FROM {fx_runs}) r WHERE n <= 5")
def recent_runs(t: Tables) -> DataFrame:
    return O.recent_runs(t.fx_runs, 5)


@query("test_case_trend", f"""
SELECT project_id, test_case_id, rr_id, nth, newest, obs FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, rr_id) AS newest FROM (
  SELECT r.*, errors + warnings AS obs, row_number() OVER (PARTITION BY test_case_id ORDER BY created_at, r.rr_id) AS nth FROM {{fx_results}} r JOIN ({Q.METRICS}) m ON r.rr_id = m.rr_id) a WHERE nth <= 30) b WHERE newest <= 60""")
def test_case_trend(t: Tables) -> DataFrame:
    return O.test_case_trend(t.fx_results, metrics(t))


@query("trend_filter", f"SELECT status, count(*) AS visible FROM ({Q.STATUS}) s JOIN {{fx_results}} r ON s.rr_id = r.rr_id WHERE status = 'in_review' GROUP BY status")
def trend_filter(t: Tables) -> DataFrame:
    return O.trend_filter(t.fx_results.join(metrics(t), "rr_id"), status="in_review").groupBy("status").agg(F.count(F.lit(1)).alias("visible"))


@query("prev_next_result", "SELECT rr_id, run_id, lag(rr_id) OVER w AS prev_id, lead(rr_id) OVER w AS next_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY run_id) AS total FROM {fx_results} WINDOW w AS (PARTITION BY run_id ORDER BY rr_id)")
def prev_next_result(t: Tables) -> DataFrame:
    return O.prev_next_result(t.fx_results)


@query("home_kpis", f"""
SELECT (SELECT CAST(round_even(sum(passed) / sum(total) * 100, 0) AS INT) FROM (SELECT * FROM ({TOTALS}) x WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 20) y) AS pass_rate,
  (SELECT CAST(sum(errors) AS BIGINT) FROM ({TOTALS}) z WHERE status = 'completed') AS open_findings""")
def home_kpis(t: Tables) -> DataFrame:
    return O.home_kpis(run_totals(t))


@query("project_kpis", f"""
SELECT p.project_id, coalesce(forms, 0) AS forms, coalesce(test_cases, 0) AS test_cases, coalesce(runs, 0) AS runs, CASE WHEN coalesce(pp + ee, 0) > 0 THEN CAST(round_even(pp / (pp + ee) * 100, 0) AS INT) ELSE 0 END AS pass_rate
FROM {{fx_projects}} p LEFT JOIN (SELECT project_id, count(DISTINCT form_id) AS forms, count(DISTINCT test_case_id) AS test_cases FROM {{fx_results}} GROUP BY project_id) c ON p.project_id = c.project_id
LEFT JOIN (SELECT project_id, count(*) AS runs, sum(passed) AS pp, sum(errors) AS ee FROM ({TOTALS}) x GROUP BY project_id) r ON p.project_id = r.project_id""")
def project_kpis(t: Tables) -> DataFrame:
    return O.project_kpis(t.fx_projects, t.fx_results, run_totals(t))


@query("defect_keys_by_test_case", KEYS)
def defect_keys_by_test_case(t: Tables) -> DataFrame:
    return O.defect_keys_by_test_case(t.fx_results, t.fx_reviews).select("test_case_id", F.array_join("keys", ",").alias("keys"))


@query("test_case_summary", SUMMARY)
def test_case_summary(t: Tables) -> DataFrame:
    return O.test_case_summary(t.fx_results, metrics(t), t.fx_reviews)


@query("project_dashboard", f"SELECT project_id, CAST(sum(defects) AS BIGINT) AS open_defects, CAST(sum(pending) AS BIGINT) AS pending, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'in_review') AS in_review FROM ({SUMMARY}) s GROUP BY project_id")
def project_dashboard(t: Tables) -> DataFrame:
    return O.project_dashboard(O.test_case_summary(t.fx_results, metrics(t), t.fx_reviews))


@query("form_dependants", "SELECT project_id, form_id, array_to_string(list_sort(list(DISTINCT test_case_id)), ',') AS test_cases FROM {fx_results} GROUP BY project_id, form_id")
def form_dependants(t: Tables) -> DataFrame:
    return O.form_dependants(t.fx_results).select("project_id", "form_id", F.array_join("test_cases", ",").alias("test_cases"))


@query("delete_blockers", "SELECT project_id, form_id, array_to_string(list_transform(l[1:3], lambda x: 'TC ' || x), ', ') || CASE WHEN len(l) > 3 THEN ' and ' || (len(l) - 3) || ' more' ELSE '' END AS used_by FROM (SELECT project_id, form_id, list_sort(list(DISTINCT test_case_id)) AS l FROM {fx_results} GROUP BY project_id, form_id) x")
def delete_blockers(t: Tables) -> DataFrame:
    return O.delete_blockers(t.fx_results)


@query("cascade_delete", "SELECT v.rr_id, v.finding_index FROM {fx_reviews} v JOIN {fx_results} r ON v.rr_id = r.rr_id WHERE r.run_id % 4 <> 0")
def cascade_delete(t: Tables) -> DataFrame:
    doomed = t.fx_results.where("run_id % 4 = 0").select("run_id").distinct()
    comments = t.fx_reviews.select("rr_id")
    return O.cascade_delete(t.fx_results, t.fx_reviews, comments, doomed)["reviews"].select("rr_id", "finding_index")


@query("global_totals", "SELECT (SELECT count(DISTINCT project_id) FROM {fx_projects}) AS projects, (SELECT count(DISTINCT run_id) FROM {fx_runs}) AS runs, (SELECT count(DISTINCT form_id) FROM {fx_results}) AS forms")
def global_totals(t: Tables) -> DataFrame:
    return O.global_totals(t.fx_projects, t.fx_runs, t.fx_results)


@query("accessibility_counts", "SELECT coalesce(severity, 'unknown') AS severity, count(*) AS issues FROM {fx_findings} WHERE bucket = 'accessibility_issues' GROUP BY 1")
def accessibility_counts(t: Tables) -> DataFrame:
    return O.accessibility_counts(t.fx_findings)


@query("enrich_results", "SELECT rr_id, run_id, coalesce(name, 'Unknown') AS project_name, 'tc_' || test_case_id AS test_case_name FROM {fx_results} r LEFT JOIN {fx_projects} p ON r.project_id = p.project_id")
def enrich_results(t: Tables) -> DataFrame:
    return O.enrich_results(t.fx_results, t.fx_projects)


@query("export_audit", "SELECT id, action, CAST(NULL AS VARCHAR) AS resource_type, CAST(NULL AS VARCHAR) AS resource_id, username, CAST(NULL AS VARCHAR) AS user_ip, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, detail, CAST(project_id AS VARCHAR) AS project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS nth FROM {fx_audit}) a WHERE nth <= 500")
def export_audit(t: Tables) -> DataFrame:
    return O.export_audit_rows(t.fx_audit)


@query("audit_recent", "SELECT id, project_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS nth FROM {fx_audit}) a WHERE nth <= 200")
def audit_recent(t: Tables) -> DataFrame:
    return O.audit_recent(t.fx_audit).select("id", "project_id", "nth")


@query("append_audit", "SELECT username, action, project_id, detail IS NOT NULL AS has_detail, count(*) AS n FROM {fx_audit} GROUP BY ALL")
def append_audit(t: Tables) -> DataFrame:
    return O.append_audit_rows(t.fx_audit).groupBy("username", "action", "project_id", F.col("detail").isNotNull().alias("has_detail")).agg(F.count(F.lit(1)).alias("n"))


@query("evidence_manifest", "SELECT run_id, count(*) AS n_results, CAST(sum(CASE WHEN run_state = 'completed' THEN 1 ELSE 0 END + CASE WHEN rr_id % 3 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN mode = 'benchmark' THEN 3 ELSE 0 END) AS BIGINT) AS n_files FROM {fx_results} GROUP BY run_id")
def evidence_manifest(t: Tables) -> DataFrame:
    benchmark = F.col("mode") == "benchmark"
    stored = t.fx_results.withColumn("result_json", F.when(F.col("run_state") == "completed", "{}")).withColumn("report_html_path", F.when(F.col("rr_id") % 3 == 0, "r.html")).withColumn("form_path", F.lit("f.pdf"))
    stored = stored.withColumn("benchmark_path", F.when(benchmark, "g.pdf")).withColumn("visual_diff_images", F.when(benchmark, '["p1.png", "p2.png"]'))
    return O.evidence_manifest(stored, metrics(t)).select("run_id", "n_results", F.col("n_files").cast("long").alias("n_files"))


@query("time_ago", f"""
SELECT rr_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago
FROM (SELECT rr_id, date_diff('second', created_at, TIMESTAMP '{NOW}') AS s FROM {{fx_results}}) x""")
def time_ago(t: Tables) -> DataFrame:
    from formcheck.functions.scalars import time_ago as ago

    return t.fx_results.select("rr_id", ago(F.col("created_at"), now()).alias("ago"))
