"""Queries on visual evidence, display classes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formcheck import constants as K
from formcheck.functions import scalars as S
from formcheck.operators import evidence as O
from formcheck.operators import findings as FO
from formcheck.operators import reviews as R
from formcheck.plans import sqltext as Q
from formcheck.plans.compare_queries import WORDS_DUCKDB, words
from formcheck.plans.findings_queries import _FLAGS
from formcheck.plans.registry import query
from formcheck.sources.fixtures import Tables


@query("reconcile_visual_batch", f"""
WITH q AS (SELECT v.*, coalesce(signature_like, false) AS sl, items FROM {{fx_visual}} v LEFT JOIN ({_FLAGS}) f ON v.rr_id = f.rr_id AND v.page = f.page)
SELECT rr_id, 'missing_content' AS bucket, page, 'critical' AS severity FROM q WHERE alignment_op = 'deleted'
UNION ALL SELECT rr_id, 'extra_content', page, 'critical' FROM q WHERE alignment_op = 'inserted'
UNION ALL SELECT rr_id, 'missing_content', page, 'high' FROM q WHERE alignment_op = 'matched' AND signature_candidate AND NOT sl
UNION ALL SELECT rr_id, 'visual_mismatches', page, CASE WHEN warn THEN 'medium' ELSE 'high' END FROM q WHERE alignment_op = 'matched' AND (major OR warn) AND similarity <= {K.REVIEW_SIMILARITY} AND items IS NULL AND NOT (signature_candidate AND NOT sl AND similarity <= {K.SIGNATURE_SIMILARITY})""")
def reconcile_visual_batch(t: Tables) -> DataFrame:
    return O.reconcile_visual_batch(t.fx_findings, t.fx_visual)


@query("infer_visual_category", f"""
WITH i AS (SELECT *, {Q.SEVERITY("severity")} * 1000000 + bucket_order * 10000 + bucket_pos AS k,
    CASE WHEN bucket = 'value_mismatches' THEN 'Value difference|critical' WHEN bucket = 'missing_content' AND regexp_matches(lower(concat_ws(' ', field, description)), '{O.SIGNATURE_HINTS}') THEN 'Signature / approval block|high'
      WHEN bucket = 'missing_content' THEN 'Missing content|high' WHEN bucket = 'extra_content' THEN 'Extra content|medium' WHEN bucket = 'layout_anomalies' THEN 'Layout difference|medium' END AS told FROM ({Q.ISSUES}) x WHERE page IS NOT NULL),
s AS (SELECT rr_id, page, arg_min(told, k) AS told FROM i WHERE told IS NOT NULL GROUP BY rr_id, page)
SELECT rr_id, row_no, split_part(c, '|', 1) AS category, split_part(c, '|', 2) AS severity FROM (SELECT v.rr_id, row_no, coalesce(told, CASE WHEN major THEN 'Visual difference|high' WHEN warn THEN 'Visual difference|medium' ELSE 'No material difference|low' END) AS c
  FROM {{fx_visual}} v LEFT JOIN s ON v.rr_id = s.rr_id AND v.page = s.page) y""")
def infer_visual_category(t: Tables) -> DataFrame:
    return O.infer_visual_category(t.fx_findings, t.fx_visual)


@query("observation_snapshots", """
SELECT o.rr_id, o.finding_index AS obs_no, CAST(o.finding_index AS INT) AS page, snapshot_path FROM {fx_reviews} o LEFT JOIN (
  SELECT rr_id, page, arg_max('snap_' || row_no, row_no) AS snapshot_path FROM {fx_visual} WHERE row_no % 2 = 0 GROUP BY rr_id, page) s ON o.rr_id = s.rr_id AND o.finding_index = s.page""")
def observation_snapshots(t: Tables) -> DataFrame:
    visual = t.fx_visual.withColumn("snapshot_path", F.when(F.col("row_no") % 2 == 0, F.concat(F.lit("snap_"), F.col("row_no").cast("string"))))
    observations = t.fx_reviews.select("rr_id", F.col("finding_index").alias("obs_no"), F.col("finding_index").cast("int").alias("page"))
    return O.observation_snapshots(observations, visual).select("rr_id", "obs_no", "page", "snapshot_path")


_CASES = "SELECT c_custkey AS test_case_id, c_custkey % 300 AS form_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 400 END AS benchmark_form_id, CASE WHEN c_custkey % 2 = 0 THEN 'benchmark' ELSE 'basic' END AS mode FROM {customer}"
_FORMS = "SELECT p_partkey AS form_id, p_name AS name FROM {part} WHERE p_partkey <= 250"


@query("form_and_golden", f"""
SELECT test_case_id, f.name AS form_name, g.name AS golden_name, CASE WHEN f.name IS NULL THEN 'form is missing' WHEN mode = 'benchmark' AND g.name IS NULL THEN 'golden copy is missing' END AS reason
FROM ({_CASES}) c LEFT JOIN ({_FORMS}) f ON c.form_id = f.form_id LEFT JOIN ({_FORMS}) g ON c.benchmark_form_id = g.form_id""")
def form_and_golden(t: Tables) -> DataFrame:
    return O.form_and_golden(t.spark.sql(_CASES, customer=t.customer), t.spark.sql(_FORMS, part=t.part))


@query("pages_union", f"SELECT rr_id, page FROM {{fx_findings}} WHERE is_object AND page IS NOT NULL AND bucket IN {Q.among([b for b, _, _ in K.ISSUE_BUCKETS])} UNION SELECT rr_id, page FROM {{fx_visual}}")
def pages_union(t: Tables) -> DataFrame:
    return O.pages_union(t.fx_findings, t.fx_visual)


@query("display_classes", """
SELECT rr_id, bucket_pos, CASE WHEN severity IN ('critical', 'high') THEN 'bad' WHEN severity = 'medium' THEN 'warn' WHEN severity = 'low' THEN 'info' ELSE 'neutral' END AS severity_class,
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END AS severity_rank FROM {fx_findings}""")
def display_classes(t: Tables) -> DataFrame:
    return t.fx_findings.select("rr_id", "bucket_pos", S.severity_chip_class(F.col("severity")).alias("severity_class"), S.severity_rank(F.col("severity")).alias("severity_rank"))


@query("verdict_text", """
SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'Overall Assessment: FAIL' || chr(10) || 'error ' || turn WHEN trim(text) <> '' THEN 'Overall Assessment: ' || CASE WHEN contains(lower(text), 'fail') THEN 'FAIL' ELSE 'PASS' END || chr(10) || trim(text) ELSE 'Overall Assessment: Completed.' END AS verdict FROM conversations""")
def verdict_text(t: Tables) -> DataFrame:
    error = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("error "), F.col("turn").cast("string")))
    return t.conversations.select("conv_id", "turn", S.verdict_text(F.col("text"), error).alias("verdict"))


@query("semantic_note", """
SELECT rr_id, row_no, CASE WHEN major THEN 'Significant visual differences detected (' || format('{:.1f}', diff_pixels_pct) || '% of pixels differ).' WHEN warn THEN 'Minor visual differences detected (' || format('{:.2f}', diff_pixels_pct) || '% of pixels differ).' ELSE 'No material visual differences detected.' END AS note FROM {fx_visual}""")
def semantic_note(t: Tables) -> DataFrame:
    return t.fx_visual.select("rr_id", "row_no", S.semantic_note(F.col("diff_pixels_pct"), F.col("major"), F.col("warn"), F.lit("")).alias("note"))


@query("word_flags", f"""
SELECT doc_id, page, count(*) FILTER (WHERE contains(lower(fontname), 'bold')) AS bold, count(*) FILTER (WHERE regexp_matches(trim(text), '^(\\([a-zA-Z0-9]\\)|[a-zA-Z]\\.|[0-9]+\\.|\\([ivxIVX]+\\)|[ivxIVX]+\\.|[•‣◦⁃∙–-])$')) AS markers,
  count(*) FILTER (WHERE trim(text) <> '' AND upper(trim(text)) NOT IN {Q.among(K.WATERMARKS)}) AS kept FROM ({WORDS_DUCKDB}) w GROUP BY doc_id, page""")
def word_flags(t: Tables) -> DataFrame:
    return words(t).groupBy("doc_id", "page").agg(F.count_if(S.is_bold_font(F.col("fontname"))).alias("bold"), F.count_if(S.is_list_marker(F.col("text"))).alias("markers"), F.count_if(~S.is_watermark(F.col("text"))).alias("kept"))


@query("filter_ocr_artifacts", f"""
SELECT rr_id, bucket, bucket_pos FROM (SELECT *, field AS a, CASE WHEN rr_id % 2 = 0 THEN replace(field, '#', 'x') ELSE 'something else' END AS b FROM (SELECT rr_id, bucket, bucket_pos, regexp_replace(description, '[^a-zA-Z]', '', 'g') AS field FROM {{fx_findings}}) x) y
WHERE NOT (bucket IN ('value_mismatches', 'format_issues') AND least(length(a), length(b)) >= 5 AND NOT contains(b, ' ') AND greatest(length(a), length(b)) <= least(length(a), length(b)) * 1.4 AND levenshtein(lower(substr(a, 1, 100)), lower(substr(b, 1, 100))) <= greatest(2, least(length(a), length(b)) // 3))""")
def filter_ocr_artifacts(t: Tables) -> DataFrame:
    plain = F.regexp_replace("description", "[^a-zA-Z]", "")
    rows = t.fx_findings.withColumn("before", plain).withColumn("after", F.when(F.col("rr_id") % 2 == 0, F.col("before")).otherwise("something else"))
    return FO.filter_ocr_artifacts(rows).select("rr_id", "bucket", "bucket_pos")


@query("schema_defaults", f"SELECT rr_id, CAST({len(K.LIST_KEYS) + 1} AS BIGINT) AS keys, count(*) AS items FROM {{fx_findings}} GROUP BY rr_id")
def schema_defaults(t: Tables) -> DataFrame:
    return FO.schema_defaults(FO.write_result_json(t.result_findings())).groupBy("rr_id").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.size("items")).alias("items"))


_STANDARDS = "SELECT CAST(p_partkey AS STRING) AS requirement_id, p_brand AS standard, p_type AS title FROM {part}"
_TAGGED = "SELECT rr_id, finding_index, concat(CAST(rr_id AS STRING), ', ', CAST(finding_index AS STRING)) AS compliance_tags FROM {fx_reviews}"


@query("requirement_tags", f"""
SELECT rr_id, finding_index, s.requirement_id, standard FROM (SELECT rr_id, finding_index, trim(unnest(string_split(compliance_tags, ','))) AS requirement_id FROM ({_TAGGED}) t) x JOIN ({_STANDARDS}) s ON x.requirement_id = s.requirement_id""")
def requirement_tags(t: Tables) -> DataFrame:
    return R.requirement_tags(t.spark.sql(_TAGGED, fx_reviews=t.fx_reviews), t.spark.sql(_STANDARDS, part=t.part)).select("rr_id", "finding_index", "requirement_id", "standard")


_BRANDS = "SELECT p_brand AS standard_id, min(p_brand) AS code, max(p_type) AS name FROM {part} GROUP BY p_brand"
_REQUIREMENTS = "SELECT CAST(p_partkey AS BIGINT) AS requirement_id, p_brand AS standard_id, concat('1.', CAST(p_size AS STRING)) AS code, p_name AS title, CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'AA' END AS level FROM {part} WHERE p_size > 3"


@query("standard_requirements", f"SELECT s.standard_id, s.code AS standard_code, name, requirement_id, r.code AS requirement_code, title, level FROM ({_BRANDS}) s LEFT JOIN ({_REQUIREMENTS}) r ON s.standard_id = r.standard_id")
def standard_requirements(t: Tables) -> DataFrame:
    return R.standard_requirements(t.spark.sql(_BRANDS, part=t.part), t.spark.sql(_REQUIREMENTS, part=t.part))
