"""Queries on findings: summaries, metrics, statuses, page decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formcheck import constants as K
from formcheck.operators import findings as O
from formcheck.plans import sqltext as Q
from formcheck.plans.registry import query
from formcheck.sources.fixtures import Tables


@query("runs_to_review", f"""
SELECT a.run_id, results, errors, warnings, passed, top_severity, top_finding FROM (
  SELECT run_id, count(*) AS results, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(passed) AS BIGINT) AS passed
  FROM ({Q.STATUS}) s JOIN {{fx_results}} r ON s.rr_id = r.rr_id GROUP BY run_id) a
LEFT JOIN (SELECT run_id, arg_min(severity, k) AS top_severity, arg_min(short, k) AS top_finding
  FROM (SELECT run_id, severity, short, {Q.SEVERITY("severity")} * 1000000000000 + t.rr_id AS k FROM ({Q.TOP}) t JOIN {{fx_results}} r ON t.rr_id = r.rr_id WHERE rank = 1) u GROUP BY run_id) b ON a.run_id = b.run_id
WHERE errors > 0 OR warnings > 0""")
def runs_to_review(t: Tables) -> DataFrame:
    return O.runs_to_review(t.fx_findings, t.fx_results)


@query("issue_rows", Q.ISSUES)
def issue_rows(t: Tables) -> DataFrame:
    return O.issue_rows(t.fx_findings)


@query("finding_short", "SELECT rr_id, bucket, bucket_pos, description AS short FROM {fx_findings}")
def finding_short(t: Tables) -> DataFrame:
    return O.finding_short(t.fx_findings)


@query("summary_counts", "SELECT rr_id, " + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in K.SUMMARY_BUCKETS) + f", count(*) FILTER (WHERE bucket IN {Q.among(K.SUMMARY_BUCKETS)}) AS total FROM {{fx_findings}} GROUP BY rr_id")
def summary_counts(t: Tables) -> DataFrame:
    return O.summary_counts(t.fx_findings)


@query("pages_impacted", f"""
SELECT rr_id, coalesce(array_to_string(list_sort(list_distinct(list(page) FILTER (WHERE is_object AND page IS NOT NULL AND bucket IN {Q.among(K.PAGE_BUCKETS)}))), ','), '') AS pages FROM {{fx_findings}} GROUP BY rr_id""")
def pages_impacted(t: Tables) -> DataFrame:
    return O.pages_impacted(t.fx_findings).select("rr_id", F.array_join("pages", ",").alias("pages"))


@query("top_findings", f"SELECT * FROM ({Q.TOP}) t WHERE rank <= 5")
def top_findings(t: Tables) -> DataFrame:
    return O.top_findings(t.fx_findings)


@query("overall_summary", f"""
SELECT c.rr_id, 'Found ' || total || ' issue(s) across ' || pages || ' page(s). Top findings: ' || coalesce(top, 'none') || '.' AS overall_summary
FROM (SELECT rr_id, count(*) FILTER (WHERE bucket IN {Q.among(K.SUMMARY_BUCKETS)}) AS total,
        count(DISTINCT CASE WHEN is_object AND bucket IN {Q.among(K.PAGE_BUCKETS)} THEN page END) AS pages FROM {{fx_findings}} GROUP BY rr_id) c
LEFT JOIN (SELECT rr_id, string_agg(short, '; ' ORDER BY rank) AS top FROM ({Q.TOP}) t WHERE rank <= 3 GROUP BY rr_id) x ON c.rr_id = x.rr_id""")
def overall_summary(t: Tables) -> DataFrame:
    return O.overall_summary(t.fx_findings)


@query("derive_metrics", Q.METRICS)
def derive_metrics(t: Tables) -> DataFrame:
    return O.derive_metrics(t.fx_findings, t.fx_results)


@query("derive_metrics_batch", f"""
SELECT r.rr_id, coalesce(e, 0) AS errors, coalesce(w, 0) + coalesce(x, 0) AS warnings, CASE WHEN coalesce(e, 0) = 0 THEN 1 ELSE 0 END AS passed
FROM {{fx_results}} r
LEFT JOIN (SELECT rr_id, count(*) FILTER (WHERE bucket IN {Q.among(K.BATCH_ERROR_BUCKETS)}) AS e, count(*) FILTER (WHERE bucket IN {Q.among(K.BATCH_WARNING_BUCKETS)}) AS w FROM {{fx_findings}} GROUP BY rr_id) f ON r.rr_id = f.rr_id
LEFT JOIN (SELECT rr_id, count(DISTINCT page) AS x FROM {{fx_visual}} v WHERE warn AND similarity <= {K.REVIEW_SIMILARITY}
  AND NOT EXISTS (SELECT 1 FROM {{fx_findings}} p WHERE p.rr_id = v.rr_id AND p.page = v.page AND p.is_object AND p.bucket IN ('visual_mismatches', 'missing_content')) GROUP BY rr_id) g ON r.rr_id = g.rr_id""")
def derive_metrics_batch(t: Tables) -> DataFrame:
    return O.derive_metrics_batch(t.fx_findings, t.fx_visual, t.fx_results)


_ERROR = "(NOT is_object OR lower(coalesce(nullif(severity, ''), CASE bucket " + " ".join(f"WHEN '{b}' THEN '{s}'" for b, _, s in K.ISSUE_BUCKETS) + " END)) IN ('critical', 'high'))"


@query("derive_metrics_by_severity", f"""
SELECT r.rr_id, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, CASE WHEN coalesce(e, 0) = 0 THEN 1 ELSE 0 END AS passed FROM {{fx_results}} r
LEFT JOIN (SELECT rr_id, count(*) FILTER (WHERE {_ERROR}) AS e, count(*) FILTER (WHERE NOT {_ERROR}) AS w FROM {{fx_findings}} WHERE bucket IN {Q.among([b for b, _, _ in K.ISSUE_BUCKETS])} GROUP BY rr_id) f ON r.rr_id = f.rr_id""")
def derive_metrics_by_severity(t: Tables) -> DataFrame:
    return O.derive_metrics_by_severity(t.fx_findings, t.fx_results)


@query("result_status", Q.STATUS)
def result_status(t: Tables) -> DataFrame:
    return O.result_status(O.derive_metrics(t.fx_findings, t.fx_results))


@query("rollup_runs", f"""
SELECT run_id, count(*) AS results, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(passed) AS BIGINT) AS passed,
  CASE WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'completed' END AS run_status
FROM ({Q.STATUS}) s JOIN {{fx_results}} r ON s.rr_id = r.rr_id GROUP BY run_id""")
def rollup_runs(t: Tables) -> DataFrame:
    return O.rollup_runs(O.result_status(O.derive_metrics(t.fx_findings, t.fx_results)), t.fx_results)


@query("scope_by_mode", f"""
SELECT f.rr_id, bucket, bucket_pos, page FROM {{fx_findings}} f JOIN {{fx_results}} r ON f.rr_id = r.rr_id
WHERE NOT (mode = 'specific' AND bucket IN {Q.among(K.OUT_OF_SPECIFIC)}) AND NOT (mode = 'basic' AND bucket = 'spelling_errors')""")
def scope_by_mode(t: Tables) -> DataFrame:
    return O.scope_by_mode(t.fx_findings, t.fx_results).select("rr_id", "bucket", "bucket_pos", "page")


@query("finding_index", f"SELECT rr_id, bucket, bucket_pos, finding_index FROM ({Q.NUMBERED}) n")
def finding_index(t: Tables) -> DataFrame:
    return O.number_findings(t.fx_findings).select("rr_id", "bucket", "bucket_pos", "finding_index")


@query("page_decisions", f"SELECT rr_id, page, status, severity, {Q.distinct_join('all_notes', '; ')} AS all_diffs FROM ({Q.PAGES}) p")
def page_decisions(t: Tables) -> DataFrame:
    return O.page_decisions(t.fx_findings, t.fx_visual).select("rr_id", "page", "status", "severity", F.array_join("all_diffs", "; ").alias("all_diffs"))


@query("page_decisions_batch", f"""
SELECT rr_id, page, status, severity, coalesce(raised, strongest, 'All matching.') AS decision, substr({Q.distinct_join('few', ' | ')}, 1, 900) AS evidence,
  CASE WHEN similarity IS NULL THEN '—' ELSE format('{{:.3f}}%', similarity * 100) END AS similarity
FROM (SELECT *, list_concat(notes[1:4], CASE WHEN raised IS NULL THEN [] ELSE [raised] END) AS few FROM ({Q.PAGES}) p) q""")
def page_decisions_batch(t: Tables) -> DataFrame:
    return O.page_decisions_batch(t.fx_findings, t.fx_visual)


@query("matched_ranges", f"""
WITH m AS (SELECT DISTINCT rr_id, page FROM ({Q.PAGES}) p WHERE status = 'match'),
i AS (SELECT rr_id, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY rr_id ORDER BY page) AS island FROM m) x GROUP BY rr_id, island),
j AS (SELECT rr_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS matched FROM i GROUP BY rr_id)
SELECT p.rr_id, coalesce(max(matched), 'None') AS matched FROM ({Q.PAGES}) p LEFT JOIN j ON p.rr_id = j.rr_id GROUP BY p.rr_id""")
def matched_ranges(t: Tables) -> DataFrame:
    return O.matched_ranges(O.page_decisions(t.fx_findings, t.fx_visual))


@query("decision_report_rows", f"""
SELECT rr_id, row_number() OVER (PARTITION BY rr_id ORDER BY r, page) AS row_no, page, status, severity, differences, n_match, n_review, n_mismatch
FROM (SELECT rr_id, page, status, severity, {Q.distinct_join('all_notes', '; ')} AS differences, CASE status WHEN 'mismatch' THEN 0 WHEN 'review' THEN 1 ELSE 9 END AS r,
  count(*) FILTER (WHERE status = 'match') OVER (PARTITION BY rr_id) AS n_match, count(*) FILTER (WHERE status = 'review') OVER (PARTITION BY rr_id) AS n_review,
  count(*) FILTER (WHERE status = 'mismatch') OVER (PARTITION BY rr_id) AS n_mismatch FROM ({Q.PAGES}) p) q WHERE r < 9""")
def decision_report_rows(t: Tables) -> DataFrame:
    return O.decision_report_rows(O.page_decisions(t.fx_findings, t.fx_visual))


_BATCH = f"""SELECT r.rr_id, CASE WHEN c.rr_id IS NOT NULL THEN 'CRITICAL' WHEN mm THEN 'FAIL' WHEN rv THEN 'REVIEW' ELSE 'PASS' END AS batch_status
FROM {{fx_results}} r LEFT JOIN (SELECT DISTINCT rr_id FROM {{fx_findings}} WHERE is_object AND lower(severity) = 'critical' AND bucket IN {Q.among(K.CRITICAL_BUCKETS)}) c ON r.rr_id = c.rr_id
LEFT JOIN (SELECT rr_id, bool_or(status = 'mismatch') AS mm, bool_or(status = 'review') AS rv FROM ({Q.PAGES}) p GROUP BY rr_id) d ON r.rr_id = d.rr_id"""


@query("batch_status", _BATCH)
def batch_status(t: Tables) -> DataFrame:
    return O.batch_status(t.fx_findings, t.fx_visual, t.fx_results)


@query("batch_summary", "SELECT " + ", ".join(f"count(*) FILTER (WHERE batch_status = '{s}') AS {s.lower()}" for s in ("PASS", "REVIEW", "FAIL", "ERROR", "CRITICAL")) + f", bool_or(batch_status IN ('CRITICAL', 'FAIL', 'ERROR')) AS failed FROM ({_BATCH}) b")
def batch_summary(t: Tables) -> DataFrame:
    return O.batch_summary(O.batch_status(t.fx_findings, t.fx_visual, t.fx_results))


@query("unclassified_major_pages", f"""
SELECT rr_id, page, 'visual_mismatches' AS bucket, 'medium' AS severity,
  'Significant visual difference detected on page ' || page || ' (' || format('{{:.1f}}', arg_min(diff_pixels_pct, row_no)) || '% pixel diff) — not classified by LLM.' AS description
FROM {{fx_visual}} v WHERE major AND alignment_op = 'matched' AND NOT EXISTS (SELECT 1 FROM {{fx_findings}} f WHERE f.rr_id = v.rr_id AND f.page = v.page AND is_object AND bucket IN {Q.among(K.CLASSIFIED_BUCKETS)})
GROUP BY rr_id, page""")
def unclassified_major_pages(t: Tables) -> DataFrame:
    return O.unclassified_major_pages(t.fx_findings, t.fx_visual)


_FLAGS = f"""SELECT rr_id, page, bool_or(regexp_matches(lower(concat_ws(' ', field, description, severity)), '{"|".join(K.SIGNATURE_WORDS)}')) AS signature_like,
  bool_or(bucket IN {Q.among(K.BUSINESS_BUCKETS)}) AS business_issue, count(*) AS items
FROM {{fx_findings}} WHERE is_object AND page IS NOT NULL AND bucket IN {Q.among([b for b, _, _ in K.ISSUE_BUCKETS])} GROUP BY rr_id, page"""


@query("page_flags", _FLAGS)
def page_flags(t: Tables) -> DataFrame:
    return O.page_flags(t.fx_findings)


@query("findings_by_page", f"SELECT rr_id, page, string_agg(bucket, ',' ORDER BY {Q.rank_case('bucket', K.PAGE_BUCKETS, 99)}, bucket_pos) AS buckets FROM {{fx_findings}} WHERE is_object AND page IS NOT NULL AND bucket IN {Q.among(K.PAGE_BUCKETS)} GROUP BY rr_id, page")
def findings_by_page(t: Tables) -> DataFrame:
    return O.findings_by_page(t.fx_findings).select("rr_id", "page", F.array_join("buckets", ",").alias("buckets"))


@query("reconcile_visual", f"""
WITH flags AS ({_FLAGS}),
q AS (SELECT v.*, CASE WHEN signature_candidate AND similarity <= {K.SIGNATURE_SIMILARITY} AND NOT coalesce(signature_like, false) THEN 'signature'
    WHEN (major OR warn) AND similarity <= {K.REVIEW_SIMILARITY} AND items IS NULL THEN 'difference' END AS kind
  FROM {{fx_visual}} v LEFT JOIN flags f ON v.rr_id = f.rr_id AND v.page = f.page WHERE alignment_op = 'matched'),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rr_id, page ORDER BY row_no) AS nth FROM q WHERE kind IS NOT NULL) x WHERE nth = 1)
SELECT rr_id, 'structural_changes' AS bucket, CAST(NULL AS INT) AS page, 'high' AS severity FROM {{fx_visual}} WHERE alignment_op = 'deleted' GROUP BY rr_id
UNION ALL SELECT rr_id, 'extra_content', page, 'high' FROM {{fx_visual}} WHERE alignment_op = 'inserted'
UNION ALL SELECT rr_id, 'missing_content', page, 'high' FROM c WHERE kind = 'signature'
UNION ALL SELECT rr_id, 'visual_mismatches', page, CASE change_pattern WHEN 'page_wide' THEN 'low' WHEN 'header_only' THEN 'medium' WHEN 'footer_area' THEN 'high' ELSE CASE WHEN warn THEN 'medium' ELSE 'high' END END FROM c WHERE kind = 'difference'""")
def reconcile_visual(t: Tables) -> DataFrame:
    return O.reconcile_visual(t.fx_findings, t.fx_visual).select("rr_id", "bucket", "page", "severity")


@query("result_json_round_trip", "SELECT rr_id, bucket, count(*) AS items, sum(page) AS pages FROM {fx_findings} GROUP BY rr_id, bucket")
def result_json_round_trip(t: Tables) -> DataFrame:
    """Findings written as JSON documents and parsed back."""
    back = O.parse_findings(O.write_result_json(t.result_findings()))
    return back.groupBy("rr_id", "bucket").agg(F.count(F.lit(1)).alias("items"), F.sum("page").alias("pages"))
