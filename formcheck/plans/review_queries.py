"""Queries on reviews and false-positive patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formcheck import constants as K
from formcheck.operators import reviews as O
from formcheck.plans import sqltext as Q
from formcheck.plans.registry import query
from formcheck.sources.fixtures import Tables

JOINED = f"SELECT n.*, coalesce(v.status, 'open') AS review_status, v.issue_key FROM ({Q.NUMBERED}) n LEFT JOIN {{fx_reviews}} v ON n.rr_id = v.rr_id AND n.finding_index = v.finding_index"
HITS = f"""SELECT f.rr_id, f.bucket, f.bucket_pos, min(p.pattern_id) AS pattern_id
FROM {{fx_findings}} f JOIN {{fx_results}} r ON f.rr_id = r.rr_id JOIN {{fx_patterns}} p ON p.project_id = r.project_id
WHERE p.is_active AND f.bucket IN {Q.among(K.REVIEW_BUCKETS)} AND (p.category = '' OR p.category = f.bucket)
  AND (p.form_id IS NULL OR (r.form_id <> 0 AND p.form_id = r.form_id))
  AND CASE p.match_mode WHEN 'exact' THEN lower(p.pattern) = lower(f.description) WHEN 'regex' THEN regexp_matches(f.description, '(?i)' || p.pattern) ELSE contains(lower(f.description), lower(p.pattern)) END
GROUP BY f.rr_id, f.bucket, f.bucket_pos"""
STATS = f"""SELECT run_id, CAST(sum(coalesce(t, 0)) AS BIGINT) AS total, CAST(sum(coalesce(d, 0)) AS BIGINT) AS defects, CAST(sum(coalesce(n, 0)) AS BIGINT) AS no_issue,
  CAST(sum(coalesce(t, 0) - coalesce(d, 0) - coalesce(n, 0)) AS BIGINT) AS pending
FROM {{fx_results}} r LEFT JOIN (SELECT rr_id, count(*) AS t, count(*) FILTER (WHERE review_status = 'resolved') AS d, count(*) FILTER (WHERE review_status = 'false_positive') AS n FROM ({JOINED}) j GROUP BY rr_id) s ON r.rr_id = s.rr_id GROUP BY run_id"""


@query("findings_with_reviews", f"SELECT rr_id, finding_index, bucket, review_status, issue_key FROM ({JOINED}) j")
def findings_with_reviews(t: Tables) -> DataFrame:
    return O.findings_with_reviews(t.fx_findings, t.fx_reviews).select("rr_id", "finding_index", "bucket", "review_status", "issue_key")


@query("review_stats", STATS)
def review_stats(t: Tables) -> DataFrame:
    return O.review_stats(t.fx_findings, t.fx_reviews, t.fx_results)


@query("recompute_after_review", f"""
SELECT r.rr_id, run_id, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, CASE WHEN coalesce(w, 0) > 0 THEN 'in_review' WHEN coalesce(e, 0) > 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN coalesce(w, 0) = 0 AND coalesce(e, 0) = 0 THEN 1 ELSE 0 END AS passed
FROM {{fx_results}} r LEFT JOIN (SELECT rr_id, count(*) FILTER (WHERE review_status = 'resolved') AS e, count(*) FILTER (WHERE review_status NOT IN ('resolved', 'false_positive')) AS w FROM ({JOINED}) j GROUP BY rr_id) s ON r.rr_id = s.rr_id""")
def recompute_after_review(t: Tables) -> DataFrame:
    return O.recompute_after_review(t.fx_findings, t.fx_reviews, t.fx_results)


@query("review_status_pivot", "SELECT rr_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("open", "in_review", "resolved", "false_positive")) + " FROM {fx_reviews} GROUP BY rr_id")
def review_status_pivot(t: Tables) -> DataFrame:
    return O.review_status_pivot(t.fx_reviews)


@query("pattern_hits", HITS)
def pattern_hits(t: Tables) -> DataFrame:
    return O.pattern_hits(t.fx_findings, t.fx_patterns, t.fx_results)


@query("suppress_false_positives", f"SELECT rr_id, bucket, bucket_pos FROM {{fx_findings}} f WHERE NOT EXISTS (SELECT 1 FROM ({HITS}) h WHERE h.rr_id = f.rr_id AND h.bucket = f.bucket AND h.bucket_pos = f.bucket_pos)")
def suppress_false_positives(t: Tables) -> DataFrame:
    return O.suppress_false_positives(t.fx_findings, t.fx_patterns, t.fx_results).select("rr_id", "bucket", "bucket_pos")


_STORED = "SELECT *, CASE WHEN pattern_id % 11 = 0 THEN NULL ELSE pattern_id % 13 END AS suppressed_count FROM {fx_patterns}"


@query("suppression_log", f"""
WITH l AS (SELECT pattern_id, h.rr_id, form_id, count(*) AS n, string_agg(h.bucket || ': ' || substr(description, 1, 120), chr(10) ORDER BY {Q.rank_case("h.bucket", K.REVIEW_BUCKETS, 99)}, h.bucket_pos) AS items
  FROM ({HITS}) h JOIN {{fx_findings}} f ON h.rr_id = f.rr_id AND h.bucket = f.bucket AND h.bucket_pos = f.bucket_pos JOIN {{fx_results}} r ON h.rr_id = r.rr_id GROUP BY pattern_id, h.rr_id, form_id)
SELECT p.pattern_id, p.project_id, match_mode, substr(pattern, 1, 80) AS pattern, CAST(coalesce(suppressed, 0) AS BIGINT) AS suppressed, CAST(coalesce(suppressed_count, 0) + coalesce(suppressed, 0) AS BIGINT) AS suppressed_count, l.rr_id, l.form_id, items
FROM ({_STORED}) p LEFT JOIN (SELECT pattern_id, sum(n) AS suppressed FROM l GROUP BY pattern_id) c ON p.pattern_id = c.pattern_id LEFT JOIN l ON p.pattern_id = l.pattern_id""")
def suppression_log(t: Tables) -> DataFrame:
    log = O.suppression_log(t.fx_findings, t.spark.sql(_STORED, fx_patterns=t.fx_patterns), t.fx_results)
    return log.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(": ", x["category"], x["description"])), "\n"))


_JUDGED = f"SELECT r.project_id, j.bucket AS category, j.description FROM ({JOINED}) j JOIN {{fx_results}} r ON j.rr_id = r.rr_id WHERE review_status = 'false_positive'"


@query("learn_false_positives", f"""
WITH l AS (SELECT DISTINCT project_id, category, trim(substr(description, 1, 80)) AS pattern FROM ({_JUDGED}) x WHERE trim(substr(description, 1, 80)) <> '')
SELECT p.project_id, p.category, p.pattern, p.is_active OR l.pattern IS NOT NULL AS is_active FROM {{fx_patterns}} p LEFT JOIN l ON p.project_id = l.project_id AND p.category = l.category AND p.pattern = l.pattern
UNION ALL SELECT l.project_id, l.category, l.pattern, true FROM l WHERE NOT EXISTS (SELECT 1 FROM {{fx_patterns}} p WHERE p.project_id = l.project_id AND p.category = l.category AND p.pattern = l.pattern)""")
def learn_false_positives(t: Tables) -> DataFrame:
    judged = O.findings_with_reviews(t.fx_findings, t.fx_reviews).where("review_status = 'false_positive'").join(t.fx_results.select("rr_id", "project_id"), "rr_id")
    return O.learn_false_positives(judged.select("project_id", F.col("bucket").alias("category"), "description"), t.fx_patterns).select("project_id", "category", "pattern", "is_active")


_ACTIONS = "SELECT rr_id, bucket_pos AS finding_index, CASE bucket_pos % 3 WHEN 0 THEN 'assign' WHEN 1 THEN 'false_positive' ELSE 'closed' END AS action, CASE WHEN rr_id % 5 = 0 THEN concat('NEW-', CAST(rr_id AS STRING)) ELSE NULL END AS issue_key, bucket_pos AS action_at FROM {fx_findings} WHERE rr_id % 3 = 0"


@query("upsert_reviews", f"""
WITH a AS ({_ACTIONS})
SELECT coalesce(r.rr_id, a.rr_id) AS rr_id, coalesce(r.finding_index, a.finding_index) AS finding_index,
  coalesce(CASE a.action WHEN 'assign' THEN 'in_review' WHEN 'false_positive' THEN 'false_positive' WHEN 'closed' THEN 'resolved' END, r.status) AS status, coalesce(a.issue_key, r.issue_key) AS issue_key
FROM {{fx_reviews}} r FULL OUTER JOIN a ON r.rr_id = a.rr_id AND r.finding_index = a.finding_index""")
def upsert_reviews(t: Tables) -> DataFrame:
    return O.upsert_reviews(t.fx_reviews, t.spark.sql(_ACTIONS, fx_findings=t.fx_findings))


_GATES = "SELECT run_id, CAST(run_id % 3 AS INT) AS max_errors_allowed, CAST(run_id % 7 AS INT) AS max_warnings_allowed, run_id % 5 = 0 AS require_all_resolved, 'approved' AS status FROM {fx_runs} WHERE run_id % 2 = 0"


@query("evaluate_gates", f"""
SELECT r.run_id, coalesce(g.status, 'pending') AS gate_status, defects, pending,
  defects <= coalesce(max_errors_allowed, 0) AND pending <= coalesce(max_warnings_allowed, 5) AND (NOT coalesce(require_all_resolved, false) OR pending = 0) AS met
FROM {{fx_runs}} r JOIN ({STATS}) s ON r.run_id = s.run_id LEFT JOIN ({_GATES}) g ON r.run_id = g.run_id""")
def evaluate_gates(t: Tables) -> DataFrame:
    return O.evaluate_gates(t.fx_runs.select("run_id"), O.review_stats(t.fx_findings, t.fx_reviews, t.fx_results), t.spark.sql(_GATES, fx_runs=t.fx_runs))


@query("failure_cause", "SELECT r.rr_id, CASE WHEN EXISTS (SELECT 1 FROM {fx_reviews} v WHERE v.rr_id = r.rr_id AND v.status = 'resolved') THEN 'confirmed defects' ELSE 'unknown' END AS cause FROM {fx_results} r WHERE run_state = 'failed'")
def failure_cause(t: Tables) -> DataFrame:
    return O.failure_cause(t.fx_results, t.fx_reviews)


@query("defect_rows", f"""
SELECT j.rr_id, finding_index, '[' || coalesce(name, '-') || '] ' || array_to_string(list_transform(string_split(bucket, '_'), lambda x: upper(x[1]) || x[2:]), ' ') || ' - ' || coalesce(field, '-') || CASE WHEN page IS NULL THEN '' ELSE ' (Page ' || page || ')' END AS title,
  concat_ws(chr(10), 'Run: ' || run_id, 'Result: ' || j.rr_id, 'Severity: ' || severity, 'Description: ' || description) AS body
FROM ({JOINED}) j JOIN {{fx_results}} r ON j.rr_id = r.rr_id LEFT JOIN {{fx_projects}} p ON r.project_id = p.project_id WHERE review_status = 'resolved' AND issue_key IS NULL AND bucket <> 'observations'""")
def defect_rows(t: Tables) -> DataFrame:
    return O.defect_rows(t.fx_findings, t.fx_reviews, t.fx_results, t.fx_projects)


_ISSUES = "SELECT concat('QA-', CAST(p_partkey % 60 AS STRING)) AS issue_key, max(p_type) AS issue_status FROM {part} GROUP BY p_partkey % 60"


@query("defect_status", f"SELECT rr_id, finding_index, v.issue_key, issue_status FROM {{fx_reviews}} v JOIN ({_ISSUES}) i ON v.issue_key = i.issue_key")
def defect_status(t: Tables) -> DataFrame:
    return O.defect_status(t.fx_reviews, t.spark.sql(_ISSUES, part=t.part)).select("rr_id", "finding_index", "issue_key", "issue_status")


_OBS = "SELECT conv_id AS rr_id, text AS observation, CASE turn % 4 WHEN 0 THEN 'certain' WHEN 1 THEN 'likely' WHEN 2 THEN NULL ELSE 'unsure' END AS confidence, CASE turn % 3 WHEN 0 THEN concat(' ', CAST(turn AS STRING)) WHEN 1 THEN 'p4' ELSE '' END AS current_page FROM {conversations}"


@query("observation_to_finding", f"""
SELECT rr_id, coalesce(observation, '') AS description, CASE coalesce(confidence, 'possible') WHEN 'certain' THEN 'high' WHEN 'likely' THEN 'medium' WHEN 'possible' THEN 'low' ELSE 'medium' END AS severity,
  TRY_CAST(trim(current_page) AS INT) AS page, nullif(current_page, '') AS field_name FROM ({_OBS}) o""")
def observation_to_finding(t: Tables) -> DataFrame:
    return O.observation_findings(t.spark.sql(_OBS, conversations=t.conversations))


@query("confidence_counts", f"SELECT rr_id, count(*) FILTER (WHERE confidence = 'certain') AS certain, count(*) FILTER (WHERE confidence = 'likely') AS likely, count(*) FILTER (WHERE confidence = 'possible') AS possible FROM ({_OBS}) o GROUP BY rr_id")
def confidence_counts(t: Tables) -> DataFrame:
    return O.confidence_counts(t.spark.sql(_OBS, conversations=t.conversations))
