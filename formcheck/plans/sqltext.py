"""SQL fragments that several oracle queries share."""

from __future__ import annotations

from formcheck import constants as K


def rank_case(column: str, order: list[str], other: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{v}' THEN {n}" for n, v in enumerate(order)) + f" ELSE {other} END"


def among(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SEVERITY = lambda c: rank_case(f"lower({c})", K.SEVERITIES, K.OTHER_SEVERITY)

_defaults = lambda n: "CASE bucket " + " ".join(f"WHEN '{row[0]}' THEN '{row[n]}'" for row in K.ISSUE_BUCKETS) + " END"

#: (rr_id, page, bucket, bucket_pos, bucket_order, category, severity, field, description) of object items in issue buckets.
ISSUES = f"""SELECT rr_id, page, bucket, bucket_pos, {rank_case("bucket", [r[0] for r in K.ISSUE_BUCKETS], 99)} AS bucket_order,
  {_defaults(1)} AS category, lower(coalesce(nullif(severity, ''), {_defaults(2)})) AS severity, field,
  coalesce(nullif(description, ''), {_defaults(1)}) AS description
FROM {{fx_findings}} WHERE is_object AND bucket IN {among([r[0] for r in K.ISSUE_BUCKETS])}"""

_count = lambda buckets: f"count(*) FILTER (WHERE bucket IN {among(buckets)})"

METRICS = f"""SELECT r.rr_id, CASE WHEN coalesce(o, 0) > 0 THEN o ELSE coalesce(e, 0) END AS errors,
  CASE WHEN coalesce(o, 0) > 0 THEN 0 ELSE coalesce(w, 0) END AS warnings,
  CASE WHEN coalesce(o, 0) = 0 AND coalesce(e, 0) = 0 THEN 1 ELSE 0 END AS passed
FROM {{fx_results}} r LEFT JOIN (SELECT rr_id, {_count(["observations"])} AS o, {_count(K.ERROR_BUCKETS)} AS e,
  {_count(K.WARNING_BUCKETS)} AS w FROM {{fx_findings}} GROUP BY rr_id) f ON r.rr_id = f.rr_id"""

STATUS = f"SELECT *, CASE WHEN errors > 0 OR warnings > 0 THEN 'in_review' ELSE 'passed' END AS status FROM ({METRICS}) m"

TOP = f"""SELECT rr_id, rank, severity, page, category, short FROM (
  SELECT rr_id, lower(coalesce(nullif(severity, ''), 'medium')) AS severity, page,
    array_to_string(list_transform(string_split(bucket, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS category, description AS short,
    row_number() OVER (PARTITION BY rr_id ORDER BY {SEVERITY("coalesce(severity, 'medium')")}, {rank_case("bucket", K.SUMMARY_BUCKETS, 99)}, bucket_pos) AS rank
  FROM {{fx_findings}} WHERE is_object AND bucket IN {among(K.SUMMARY_BUCKETS)}) t"""

DECISIONS = f"""SELECT coalesce(f.rr_id, v.rr_id) AS rr_id, coalesce(f.page, v.page) AS page, similarity, notes, strongest, kind,
    CASE WHEN f.page IS NULL THEN 'match' WHEN f.bucket IN {among(K.MISMATCH_BUCKETS)} THEN 'mismatch' ELSE 'review' END AS base, f.severity AS severity0
  FROM (SELECT rr_id, page, arg_min(bucket, k) AS bucket, arg_min(severity, k) AS severity, arg_min(description, k) AS strongest,
      list(description ORDER BY bucket_order, bucket_pos) AS notes
    FROM (SELECT *, {SEVERITY("severity")} * 1000000 + bucket_order * 10000 + bucket_pos AS k FROM ({ISSUES}) i WHERE page IS NOT NULL) j GROUP BY rr_id, page) f
  FULL OUTER JOIN (SELECT rr_id, page, arg_min(similarity, kind * 100000 + row_no) AS similarity, min(kind) AS kind
    FROM (SELECT *, CASE WHEN signature_candidate THEN 0 WHEN major THEN 1 WHEN warn THEN 2 ELSE 3 END AS kind FROM {{fx_visual}}) w GROUP BY rr_id, page) v
  ON f.rr_id = v.rr_id AND f.page = v.page"""
RAISED = """SELECT *, CASE WHEN kind = 0 AND base <> 'mismatch' THEN 'Signature-region change detected.'
    WHEN kind = 1 AND base = 'match' THEN 'Significant visual difference detected.' WHEN kind = 2 AND base = 'match' THEN 'Visual difference detected.' END AS raised
  FROM (%s) d""" % DECISIONS
PAGES = f"""SELECT rr_id, page, CASE WHEN raised IS NOT NULL THEN 'review' ELSE base END AS status,
    CASE WHEN raised LIKE 'Sig%' THEN 'medium' WHEN raised IS NOT NULL THEN 'low' ELSE coalesce(severity0, 'low') END AS severity,
    list_concat(coalesce(notes, []), CASE WHEN raised IS NULL THEN [] ELSE [raised] END) AS all_notes, strongest, raised, similarity, coalesce(notes, []) AS notes
  FROM ({RAISED}) r"""

NUMBERED = f"""SELECT rr_id, bucket, bucket_pos, page, severity, field, description, is_object, finding_index FROM (
  SELECT *, row_number() OVER (PARTITION BY rr_id ORDER BY {rank_case("bucket", [*K.REVIEW_BUCKETS, "observations"], 99)}, bucket_pos) - 1 AS finding_index
  FROM {{fx_findings}} WHERE bucket IN {among([*K.REVIEW_BUCKETS, "observations"])}) n WHERE bucket <> 'observations' OR is_object"""

#: An ordered list without repeats, joined.
distinct_join = lambda c, sep: f"array_to_string(list_filter({c}, lambda x, i: x <> '' AND list_position({c}, x) = i), '{sep}')"
