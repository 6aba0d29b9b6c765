"""Stand-in views: the library's tables seen through TPC-H-like driver tables.

One SQL text serves Spark and DuckDB (fx_lines and fx_pages have one for each); {table} stands for a driver
table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FX_RESULTS = """
SELECT o_orderkey AS rr_id, o_custkey AS project_id,
       o_custkey * 4 + o_orderkey % 4 AS test_case_id,
       o_custkey * 100000 + (year(o_orderdate) - 1990) * 100 + month(o_orderdate) AS run_id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'benchmark'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'specific' ELSE 'basic' END AS mode,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS run_state,
       o_custkey % 10 AS form_id, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {orders}
"""

_BUCKET = """CASE l_partkey % 11 WHEN 0 THEN 'spelling_errors' WHEN 1 THEN 'format_issues' WHEN 2 THEN 'value_mismatches'
         WHEN 3 THEN 'missing_content' WHEN 4 THEN 'extra_content' WHEN 5 THEN 'layout_anomalies'
         WHEN 6 THEN 'typography_issues' WHEN 7 THEN 'structural_changes' WHEN 8 THEN 'compliance_issues'
         WHEN 9 THEN 'visual_mismatches' ELSE 'accessibility_issues' END"""
_PAGE = "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) % 12 + 1 END"
_SEVERITY = "CASE l_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE NULL END"

FX_FINDINGS = f"""
SELECT l_orderkey AS rr_id,
       {_BUCKET} AS bucket,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
         l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS bucket_pos,
       {_PAGE} AS page,
       {_SEVERITY} AS severity,
       p_brand AS field, concat(p_type, ' field ', p_brand, ' differs') AS description, (l_orderkey + l_linenumber) % 9 <> 8 AS is_object
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
"""

FX_REVIEWS = """
SELECT rr_id, bucket_pos AS finding_index,
       CASE (rr_id + bucket_pos) % 4 WHEN 1 THEN 'resolved' WHEN 2 THEN 'false_positive' ELSE 'in_review' END AS status,
       CASE WHEN (rr_id + bucket_pos) % 8 = 1 THEN concat('QA-', CAST(rr_id % 97 AS STRING)) ELSE NULL END AS issue_key
FROM {fx_findings} WHERE (rr_id + bucket_pos) % 4 <> 0
"""

FX_VISUAL = """
SELECT rr_id, row_no AS page, row_no, round((100 - pct) / 100, 3) AS similarity, pct AS diff_pixels_pct,
       pct >= 2.0 AS major, pct >= 0.1 AND pct < 2.0 AS warn,
       CASE WHEN flag = 'R' AND row_no % 3 = 0 THEN true ELSE false END AS signature_candidate,
       CASE WHEN row_no % 9 = 8 THEN 'deleted' WHEN row_no % 9 = 7 THEN 'inserted' ELSE 'matched' END AS alignment_op,
       CASE row_no % 5 WHEN 0 THEN 'page_wide' WHEN 1 THEN 'header_only' WHEN 2 THEN 'footer_area'
         WHEN 3 THEN 'body_content' ELSE 'no_change' END AS change_pattern
FROM (SELECT l_orderkey AS rr_id, l_returnflag AS flag, CAST(round(l_discount * 30, 4) AS DOUBLE) AS pct,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
          l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS INT) AS row_no
      FROM {lineitem}) v
"""

FX_PATTERNS = """
SELECT p_partkey AS pattern_id, p_partkey % 50 AS project_id,
       CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 10 ELSE NULL END AS form_id,
       CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'value_mismatches'
         WHEN p_partkey % 4 = 2 THEN 'missing_content' ELSE 'visual_mismatches' END AS category,
       CASE p_partkey % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'exact' ELSE 'regex' END AS match_mode,
       CASE p_partkey % 3 WHEN 0 THEN lower(p_brand) WHEN 1 THEN concat(p_type, ' FIELD ', p_brand, ' differs')
         ELSE concat('^', lower(p_type), ' field') END AS pattern,
       p_partkey % 7 <> 0 AS is_active
FROM {part}
"""

FX_AUDIT = """
SELECT event_id AS id, concat('finding.', event_type) AS action, user_id AS project_id,
       concat('user', CAST(user_id % 10 AS STRING)) AS username, props AS detail, ts AS created_at
FROM {events}
"""

FX_FIELDS_EXPECTED = """
SELECT p_partkey % 20 AS pair_id, p_name AS field_name, min(p_type) AS field_type
FROM {part} WHERE p_partkey % 7 <> 0 GROUP BY p_partkey % 20, p_name
"""

FX_FIELDS_ACTUAL = """
SELECT p_partkey % 20 AS pair_id, p_name AS field_name, min(CASE WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE p_type END) AS field_type
FROM {part} WHERE p_partkey % 5 <> 0 GROUP BY p_partkey % 20, p_name
"""

FX_MEMBERS = """
SELECT c_custkey AS project_id, c_custkey % 25 AS user_id,
       CASE WHEN c_custkey % 25 = 0 THEN 'admin' WHEN c_custkey % 25 < 10 THEN 'reviewer' ELSE 'viewer' END AS role
FROM {customer}
"""

FX_PROJECTS = "SELECT c_custkey AS project_id, c_name AS name, c_mktsegment AS area FROM {customer}"

FX_RUNS = """
SELECT run_id, min(project_id) AS project_id, max(created_at) AS created_at, count(*) AS total,
       CASE WHEN bool_or(run_state = 'running') THEN 'running' ELSE 'completed' END AS status
FROM {fx_results} GROUP BY run_id
"""

FX_LINES = """
SELECT doc_id, CAST(pos AS INT) AS line_no, CAST(floor(pos / 5) AS INT) + 1 AS page, line,
       (doc_id + pos) % 7 <> 0 AS in_expected, (doc_id + pos) % 11 <> 0 AS in_actual
FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line
"""

FX_LINES_DUCKDB = """
SELECT doc_id, CAST(pos AS INT) AS line_no, CAST(floor(pos / 5) AS INT) + 1 AS page, line,
       (doc_id + pos) % 7 <> 0 AS in_expected, (doc_id + pos) % 11 <> 0 AS in_actual
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {documents}) t
"""

PAGED_DOCUMENTS = """
SELECT doc_id, transform(sequence(0, CAST(floor((size(lines) - 1) / 5) AS INT)), p -> struct(p + 1 AS page, transform(slice(lines, p * 5 + 1, 5), (line, k) -> struct(p * 5 + k AS line_no, line AS line)) AS lines)) AS pages
FROM (SELECT doc_id, split(text, '\\n') AS lines FROM {documents} WHERE text IS NOT NULL) t
"""

_of = lambda text, line: re.sub(r"\bl_", f"{line}.l_", text)

#: The lines of an order in the order of fx_findings and fx_visual, each with the parts that it is joined with.
_ORDERED = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
RESULT_LISTS = f"""
SELECT rr_id,
       transform(flatten(transform(lines, x -> transform(coalesce(x.parts, array()), p -> struct(x AS line, p AS part)))), (f, i) -> struct({_of(_BUCKET, "f.line")} AS bucket, i AS bucket_pos,
         {_of(_PAGE, "f.line")} AS page, {_of(_SEVERITY, "f.line")} AS severity, f.part.p_brand AS field,
         concat(f.part.p_type, ' field ', f.part.p_brand, ' differs') AS description, (rr_id + f.line.l_linenumber) % 9 <> 8 AS is_object)) AS findings,
       transform(transform(lines, x -> struct(x.l_returnflag AS flag, CAST(round(x.l_discount * 30, 4) AS DOUBLE) AS pct)), (v, i) -> struct(i + 1 AS row_no, round((100 - v.pct) / 100, 3) AS similarity, v.pct AS diff_pixels_pct,
         v.pct >= 2.0 AS major, v.pct >= 0.1 AND v.pct < 2.0 AS warn, CASE WHEN v.flag = 'R' AND (i + 1) % 3 = 0 THEN true ELSE false END AS signature_candidate,
         CASE WHEN (i + 1) % 9 = 8 THEN 'deleted' WHEN (i + 1) % 9 = 7 THEN 'inserted' ELSE 'matched' END AS alignment_op)) AS visual
FROM (SELECT l_orderkey AS rr_id, sort_array(collect_list(struct({", ".join(_ORDERED)}, parts))) AS lines
      FROM {{lineitem}} LEFT JOIN (SELECT p_partkey, collect_list(struct(p_brand, p_type)) AS parts FROM {{part}} GROUP BY p_partkey) p ON l_partkey = p_partkey GROUP BY l_orderkey) o
"""

#: The rows of fx_findings, numbered by rr_id itself and told in words after the shuffle.
RESULT_FINDINGS = f"""
SELECT rr_id, {_BUCKET} AS bucket, CAST(pos - 1 AS INT) AS bucket_pos, {_PAGE} AS page, {_SEVERITY} AS severity,
       p_brand AS field, concat(p_type, ' field ', p_brand, ' differs') AS description, (rr_id + l_linenumber) % 9 <> 8 AS is_object
FROM (SELECT *, row_number() OVER (PARTITION BY rr_id ORDER BY {", ".join(_ORDERED[:-1])}) AS pos
      FROM (SELECT l_orderkey AS rr_id, l.*, p_brand, p_type FROM {{lineitem}} l JOIN {{part}} p ON l_partkey = p_partkey) j) n
"""

VIEWS = {
    "fx_results": FX_RESULTS, "fx_findings": FX_FINDINGS, "fx_reviews": FX_REVIEWS, "fx_visual": FX_VISUAL, "fx_patterns": FX_PATTERNS,
    "fx_audit": FX_AUDIT, "fx_fields_expected": FX_FIELDS_EXPECTED, "fx_fields_actual": FX_FIELDS_ACTUAL, "fx_members": FX_MEMBERS,
    "fx_projects": FX_PROJECTS, "fx_runs": FX_RUNS, "fx_lines": FX_LINES,
}
DUCKDB = VIEWS | {"fx_lines": FX_LINES_DUCKDB}
NAME = re.compile(r"\{([a-z]\w*)\}")


class Tables:
    """Driver tables and stand-in views of one directory, as DataFrames: tables.fx_findings, tables.part, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{t: getattr(self, t) for t in NAME.findall(VIEWS[name])})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def paged_documents(self) -> DataFrame:
        """(doc_id, pages array<struct<page, lines array<struct<line_no, line>>>>): the lines of fx_lines as a document holds them, five
        a page. A document is cut where it stands, without a shuffle; only where numbers repeat are lines brought together."""
        documents = self.documents
        if documents.groupBy("doc_id").count().where("count > 1").limit(1).count():
            lines = self.fx_lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
            return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "lines"))).alias("pages"))
        return self.spark.sql(PAGED_DOCUMENTS, documents=documents)

    def result_lists(self) -> DataFrame:
        """(rr_id, findings, visual): the rows of fx_findings and fx_visual of a result as lists, each in its order. The lines of a result are
        brought together once for both."""
        return self.spark.sql(RESULT_LISTS, lineitem=self.lineitem, part=self.part)

    def result_findings(self) -> DataFrame:
        """The rows of fx_findings, dealt by rr_id: what groups them by result needs no further shuffle."""
        return self.spark.sql(RESULT_FINDINGS, lineitem=self.lineitem, part=self.part)

    def document_pages(self) -> DataFrame:
        """(doc_id, page, lines): the pages of paged_documents(), each a row."""
        # Of a plain column Spark would first filter on its size, which makes the pages again for each of them.
        return self.paged_documents().select("doc_id", F.inline(F.filter("pages", lambda p: p["page"] > 0)))


def duckdb_sql(query: str) -> str:
    """The query with the views that it names (in braces), directly or through others, as WITH clauses."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in NAME.findall(text):
            if name in DUCKDB and name not in order:
                need(DUCKDB[name])
                order.append(name)

    need(query)
    plain = lambda text: NAME.sub(r"\1", text)
    views = ",\n".join(f"{name} AS ({plain(DUCKDB[name])})" for name in order)
    body = plain(query).strip()
    if not views:
        return body
    head = re.match(r"WITH (RECURSIVE )?", body, re.IGNORECASE)
    return f"{head[0]}{views}, {body[head.end() :]}" if head else f"WITH {views}\n{body}"
