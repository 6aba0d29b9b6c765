"""Findings: from result documents to one long table, noise filters, summaries, metrics, page decisions.

findings(rr_id, bucket, bucket_pos, page, severity, field, description, is_object, ...): one row per item.
visual(rr_id, row_no, page, similarity, major, warn, signature_candidate, alignment_op, ...): one row per
compared page. Everything is grouped by rr_id, a key with many values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formcheck import constants as K
from formcheck.functions import scalars as S

ITEM = ["page", "severity", "category", "field", "field_name", "name", "label", "description", "text", "expected_value", "actual_value", "baseline_value", "current_value", "evidence", "details", "reason", "note", "observation", "confidence", "current_page"]


def _item_lists(results: DataFrame) -> DataFrame:
    """results(rr_id, result_json) -> (rr_id, x), x a struct a bucket: bucket, listed array<string> (raw JSON of the items) and, only where the
    document holds anything but lists or nulls under a bucket, raw string (JSON of the value). A document of lists is thus read
    once. Of a key that is told twice the last counts."""
    buckets, corrupt = [*K.LIST_KEYS, "observations"], "_corrupt_record"
    fields = lambda kind: ", ".join(f"{b} {kind}" for b in buckets)
    document = F.when(F.trim("result_json").startswith("{"), F.col("result_json"))
    lists = F.from_json(document, f"{fields('array<string>')}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt})
    rows = results.select("rr_id", "result_json", lists.alias("lists"))
    odd = F.when(F.col("lists")[corrupt].isNotNull(), F.from_json("result_json", fields("string")))
    of = lambda b: F.struct(F.lit(b).alias("bucket"), F.col("lists")[b].alias("listed"), F.col("odd")[b].alias("raw"))
    return rows.select("rr_id", "lists", odd.alias("odd")).select("rr_id", F.explode(F.array(*[of(b) for b in buckets])).alias("x"))


def schema_defaults(results: DataFrame) -> DataFrame:
    """results(rr_id, result_json) -> one row per (rr_id, bucket) with items array<string> (raw JSON): null and
    missing lists are empty, a scalar or object is a list of one, a non-object document has none."""
    none, raw = F.array().cast("array<string>"), F.trim("x.raw")
    one = F.when(raw == "null", none).when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), none)).otherwise(F.array("x.raw"))
    return _item_lists(results).select("rr_id", "x.bucket", F.when(F.col("x.raw").isNull(), F.coalesce(F.col("x.listed"), none)).otherwise(one).alias("items"))


def parse_findings(results: DataFrame) -> DataFrame:
    """results(rr_id, result_json) -> long findings. Items that are no objects keep their place and text."""
    rows = schema_defaults(results).select("rr_id", "bucket", F.posexplode("items").alias("bucket_pos", "raw"))
    item = F.from_json("raw", ", ".join(f"{c} string" for c in ITEM))
    rows = rows.withColumn("is_object", F.trim("raw").startswith("{")).withColumn("item", F.when(F.col("is_object"), item))
    of = lambda name: F.col("item")[name]
    return rows.select(
        "rr_id", "bucket", "bucket_pos", S.safe_page(of("page")).alias("page"), F.lower(of("severity")).alias("severity"), of("category").alias("category"),
        S.pick_first(of("field"), of("field_name"), of("name"), of("label")).alias("field"), F.coalesce(of("description"), F.when(~F.col("is_object"), F.col("raw"))).alias("description"),
        S.pick_first(of("expected_value"), of("baseline_value")).alias("before"), S.pick_first(of("actual_value"), of("current_value")).alias("after"), of("evidence").alias("evidence"), "is_object", "raw",
        S.pick_first(of("description"), of("details"), of("reason"), of("note"), of("evidence")).alias("told"),
    )


def write_result_json(findings: DataFrame) -> DataFrame:
    """Findings back to one JSON document per result: bucket -> list of items in order. The findings of a result are brought
    together once; its buckets, which are few, are lists made where they stand."""
    item = F.struct("bucket", "bucket_pos", F.struct(*[c for c in ("page", "severity", "field", "description") if c in findings.columns]).alias("item"))
    rows = findings.groupBy("rr_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = rows.select("rr_id", "items", F.array_distinct(F.col("items")["bucket"]).alias("buckets"))
    lists = F.transform("buckets", lambda b: F.filter("items", lambda x: x["bucket"].eqNullSafe(b))["item"])
    return rows.select("rr_id", F.to_json(F.map_from_arrays("buckets", lists)).alias("result_json"))


def filter_ocr_artifacts(findings: DataFrame) -> DataFrame:
    """Drop value and format findings whose two values differ by reading noise only. The values come from
    before/after, else from "Changed from '..' to '..'" in the description."""
    said = r"""(?s)[Cc]hanged from ['"](.+?)['"] to ['"](.+?)['"]"""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    told = blank(F.col("before")) & blank(F.col("after"))
    before = F.when(told, F.regexp_extract("description", said, 1)).otherwise(F.col("before"))
    after = F.when(told, F.regexp_extract("description", said, 2)).otherwise(F.col("after"))
    return findings.where(~(F.col("bucket").isin("value_mismatches", "format_issues") & F.coalesce(S.is_ocr_artifact(before, after), F.lit(False))))


def scope_by_mode(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Drop the buckets that a result's mode does not look at."""
    modes = results.select("rr_id", "mode")
    out = (F.col("mode") == "specific") & F.col("bucket").isin(K.OUT_OF_SPECIFIC) | (F.col("mode") == "basic") & (F.col("bucket") == "spelling_errors")
    return findings.join(modes, "rr_id").where(~out).drop("mode")


def issue_rows(findings: DataFrame) -> DataFrame:
    """Object items of the eight issue buckets with their defaults: category, severity, description, order. The
    description is the first given of description, details, reason, note and evidence."""
    told = [F.col(c) for c in ("description", "told", "evidence") if c in findings.columns]
    rows = [(b, n, c, s) for n, (b, c, s) in enumerate(K.ISSUE_BUCKETS)]
    names = F.create_map(*[F.lit(x) for b, n, c, s in rows for x in (b, f"{n}|{c}|{s}")])
    defaults = F.split(names[F.col("bucket")], r"\|")
    return findings.where(F.col("is_object") & F.col("bucket").isin([r[0] for r in rows])).select(
        "rr_id", "page", "bucket", "bucket_pos", defaults[0].cast("int").alias("bucket_order"),
        (S.pick_first(F.col("category"), defaults[1]) if "category" in findings.columns else defaults[1]).alias("category"),
        F.lower(S.pick_first(F.col("severity"), defaults[2])).alias("severity"), "field", S.pick_first(*told, defaults[1]).alias("description"),
    )


def finding_short(findings: DataFrame) -> DataFrame:
    """Short label: the description, else the field, else the bucket."""
    return findings.select("rr_id", "bucket", "bucket_pos", S.pick_first(F.col("description"), F.col("field"), F.col("bucket")).alias("short"))


def summary_counts(findings: DataFrame) -> DataFrame:
    """Count per bucket (nine buckets) and total per result; items that are no objects count too."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in K.SUMMARY_BUCKETS]
    return findings.groupBy("rr_id").agg(*counts, F.count_if(F.col("bucket").isin(K.SUMMARY_BUCKETS)).alias("total"))


def pages_impacted(findings: DataFrame) -> DataFrame:
    """Distinct pages over eleven buckets, sorted."""
    page = F.when(F.col("bucket").isin(K.PAGE_BUCKETS) & F.col("is_object"), F.col("page"))
    return findings.groupBy("rr_id").agg(F.sort_array(F.collect_set(page)).alias("pages"))


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The n gravest findings of a result; ties in the order of buckets and items. A missing severity is medium."""
    severity = F.lower(S.pick_first(F.col("severity"), F.lit("medium")))
    w = Window.partitionBy("rr_id").orderBy("severity_order", "bucket_order", "bucket_pos")
    rows = findings.where(F.col("bucket").isin(K.SUMMARY_BUCKETS) & F.col("is_object"))
    rows = rows.withColumn("severity", severity).withColumn("severity_order", S.severity_rank(severity)).withColumn("bucket_order", S.rank_of(F.col("bucket"), K.SUMMARY_BUCKETS, 99))
    title = F.initcap(F.replace("bucket", F.lit("_"), F.lit(" ")))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("rr_id", "rank", "severity", "page", title.alias("category"), S.pick_first(F.col("description"), F.col("field"), F.col("bucket")).alias("short"))


def overall_summary(findings: DataFrame) -> DataFrame:
    """Sentence of a result: number of issues and pages, the three top findings."""
    top = top_findings(findings, 3).groupBy("rr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "short"))), lambda x: x["short"]), "; ").alias("top"))
    rows = summary_counts(findings).select("rr_id", "total").join(pages_impacted(findings), "rr_id").join(top, "rr_id", "left")
    text = F.format_string("Found %d issue(s) across %d page(s). Top findings: %s.", "total", F.size("pages"), F.coalesce("top", F.lit("none")))
    return rows.select("rr_id", text.alias("overall_summary"))


def derive_metrics(findings: DataFrame, results: DataFrame) -> DataFrame:
    """(rr_id, errors, warnings, passed) of every result. Observations, where there are any, are the errors and
    nothing else counts."""
    count = lambda buckets: F.count_if(F.col("bucket").isin(buckets))
    sums = findings.groupBy("rr_id").agg(count(["observations"]).alias("o"), count(K.ERROR_BUCKETS).alias("e"), count(K.WARNING_BUCKETS).alias("w"))
    seen = F.col("o") > 0
    rows = results.select("rr_id").join(sums, "rr_id", "left").fillna(0, ["o", "e", "w"])
    return rows.select("rr_id", F.when(seen, F.col("o")).otherwise(F.col("e")).alias("errors"), F.when(seen, F.lit(0)).otherwise(F.col("w")).alias("warnings"), F.when(~seen & (F.col("e") == 0), 1).otherwise(0).alias("passed"))


def derive_metrics_batch(findings: DataFrame, visual: DataFrame, results: DataFrame) -> DataFrame:
    """Batch form: fewer buckets; warned pages that no visual or missing-content finding covers are warnings."""
    count = lambda buckets: F.count_if(F.col("bucket").isin(buckets))
    sums = findings.groupBy("rr_id").agg(count(K.BATCH_ERROR_BUCKETS).alias("errors"), count(K.BATCH_WARNING_BUCKETS).alias("w"))
    promoted = findings.where(F.col("bucket").isin("visual_mismatches", "missing_content") & F.col("is_object") & F.col("page").isNotNull()).select("rr_id", "page")
    warned = visual.where(F.col("warn") & F.col("page").isNotNull() & (F.coalesce("similarity", F.lit(1.0)) <= K.REVIEW_SIMILARITY)).select("rr_id", "page").distinct()
    extra = warned.join(promoted, ["rr_id", "page"], "left_anti").groupBy("rr_id").agg(F.count(F.lit(1)).alias("x"))
    rows = results.select("rr_id").join(sums, "rr_id", "left").join(extra, "rr_id", "left").fillna(0, ["errors", "w", "x"])
    return rows.select("rr_id", "errors", (F.col("w") + F.col("x")).alias("warnings"), F.when(F.col("errors") == 0, 1).otherwise(0).alias("passed"))


def derive_metrics_by_severity(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Older form: critical and high findings are errors, others warnings; an item that is no object is an error."""
    severity = F.lower(S.pick_first(F.col("severity"), _default_severity(F.col("bucket"))))
    error = ~F.col("is_object") | severity.isin("critical", "high")
    rows = findings.where(F.col("bucket").isin([b for b, _, _ in K.ISSUE_BUCKETS]))
    sums = rows.groupBy("rr_id").agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"))
    return results.select("rr_id").join(sums, "rr_id", "left").fillna(0, ["errors", "warnings"]).withColumn("passed", F.when(F.col("errors") == 0, 1).otherwise(0))


def _default_severity(bucket: Column) -> Column:
    return F.create_map(*[F.lit(x) for b, _, s in K.ISSUE_BUCKETS for x in (b, s)])[bucket]


def result_status(metrics: DataFrame) -> DataFrame:
    """in_review with findings, else failed with an error text, else passed. metrics may have `error`."""
    error = F.coalesce("error", F.lit("")) != "" if "error" in metrics.columns else F.lit(False)
    return metrics.withColumn("status", F.when((F.col("errors") > 0) | (F.col("warnings") > 0), "in_review").when(error, "failed").otherwise("passed"))


def rollup_runs(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: sums, and failed when every result failed."""
    rows = results.select("rr_id", "run_id").join(metrics, "rr_id")
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("results"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.sum("passed").alias("passed"),
        F.when(F.every(F.col("status") == "failed"), "failed").otherwise("completed").alias("run_status"),
    )


def runs_to_review(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Flagship: which runs need review, and why. One row per run with a finding: totals and the gravest finding."""
    metrics = result_status(derive_metrics(findings, results))
    runs = rollup_runs(metrics, results).where((F.col("errors") > 0) | (F.col("warnings") > 0))
    top = top_findings(findings, 1).join(results.select("rr_id", "run_id"), "rr_id")
    first = top.groupBy("run_id").agg(F.min_by(F.struct("severity", "short"), F.struct(S.severity_rank(F.col("severity")), "rr_id")).alias("top"))
    return runs.join(first, "run_id", "left").select("run_id", "results", "errors", "warnings", "passed", F.col("top.severity").alias("top_severity"), F.col("top.short").alias("top_finding"))


def number_findings(findings: DataFrame) -> DataFrame:
    """finding_index: 0-based number over the eight review buckets in order, then the observations. An
    observation that is no object takes a number but is no finding."""
    order = S.rank_of(F.col("bucket"), [*K.REVIEW_BUCKETS, "observations"], 99)
    w = Window.partitionBy("rr_id").orderBy("bucket_order", "bucket_pos")
    rows = findings.withColumn("bucket_order", order).where(F.col("bucket_order") < 99).withColumn("finding_index", F.row_number().over(w) - 1)
    return rows.where((F.col("bucket") != "observations") | F.col("is_object")).drop("bucket_order")


def page_findings(findings: DataFrame) -> DataFrame:
    """Strongest finding of each page and all its descriptions in order."""
    key = F.struct(S.severity_rank(F.col("severity")).alias("rank"), "bucket_order", "bucket_pos")
    rows = issue_rows(findings).where("page IS NOT NULL")
    return rows.groupBy("rr_id", "page").agg(
        F.min_by(F.struct("severity", "bucket", "description"), key).alias("strongest"),
        F.transform(F.array_sort(F.collect_list(F.struct("bucket_order", "bucket_pos", "description"))), lambda x: x["description"]).alias("notes"),
    )


def _page_states(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """Findings and strongest visual row of each page, outer-joined on (rr_id, page)."""
    kind = F.when(F.col("signature_candidate"), 0).when(F.col("major"), 1).when(F.col("warn"), 2).otherwise(3)
    extra = [c if c in visual.columns else F.lit(None).cast("string").alias(c) for c in ("note", "signature_reason", "snapshot_path")]
    rows = visual.where("page IS NOT NULL").select("rr_id", "page", "row_no", "similarity", kind.alias("kind"), *extra)
    seen = rows.groupBy("rr_id", "page").agg(F.min_by(F.struct("kind", "similarity", "note", "signature_reason", "snapshot_path"), F.struct("kind", "row_no")).alias("visual"))
    joined = page_findings(findings).join(seen, ["rr_id", "page"], "full_outer")
    base = F.when(F.col("strongest").isNull(), "match").when(F.col("strongest.bucket").isin(K.MISMATCH_BUCKETS), "mismatch").otherwise("review")
    joined = joined.withColumn("base", base)
    kind, note = F.col("visual.kind"), F.col("visual.note")
    raised = (
        F.when((kind == 0) & (F.col("base") != "mismatch"), F.struct(F.lit("medium").alias("severity"), S.pick_first(F.col("visual.signature_reason"), F.lit("Signature-region change detected.")).alias("text")))
        .when((kind == 1) & (F.col("base") == "match"), F.struct(F.lit("medium").alias("severity"), S.pick_first(note, F.lit("Significant visual difference detected.")).alias("text")))
        .when((kind == 2) & (F.col("base") == "match"), F.struct(F.lit("low").alias("severity"), S.pick_first(note, F.lit("Visual difference detected.")).alias("text")))
    )
    return joined.withColumn("raised", raised)


def page_decisions(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """One row per page with a finding or a visual row: status (match, review, mismatch), severity and all
    distinct evidences in order."""
    rows = _page_states(findings, visual)
    status = F.when(F.col("raised").isNotNull(), "review").otherwise(F.col("base"))
    notes = F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.when(F.col("raised").isNotNull(), F.array("raised.text")).otherwise(F.array().cast("array<string>")))
    severity = F.coalesce("raised.severity", "strongest.severity", F.lit("low"))
    return rows.select("rr_id", "page", status.alias("status"), severity.alias("severity"), F.array_distinct(F.filter(notes, lambda x: x != "")).alias("all_diffs"), F.coalesce("visual.snapshot_path", F.lit("")).alias("snapshot"))


def page_decisions_batch(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """Batch form: decision text, similarity text, the first four evidences joined, 900 characters at most."""
    rows = _page_states(findings, visual)
    status = F.when(F.col("raised").isNotNull(), "review").otherwise(F.col("base"))
    notes = F.concat(F.slice(F.coalesce("notes", F.array().cast("array<string>")), 1, 4), F.when(F.col("raised").isNotNull(), F.array("raised.text")).otherwise(F.array().cast("array<string>")))
    decision = F.coalesce("raised.text", "strongest.description", F.lit("All matching."))
    evidence = F.substring(F.array_join(F.array_distinct(F.filter(notes, lambda x: x != "")), " | "), 1, 900)
    return rows.select("rr_id", "page", status.alias("status"), F.coalesce("raised.severity", "strongest.severity", F.lit("low")).alias("severity"), decision.alias("decision"), evidence.alias("evidence"), S.similarity_text(F.col("visual.similarity")).alias("similarity"))


def matched_ranges(decisions: DataFrame) -> DataFrame:
    """Matched pages of a result as ranges."""
    return decisions.groupBy("rr_id").agg(S.page_ranges(F.collect_set(F.when(F.col("status") == "match", F.col("page")))).alias("matched"))


def decision_report_rows(decisions: DataFrame) -> DataFrame:
    """Rows of a report: mismatch pages, then review pages, by page; header counts on each."""
    rank = S.rank_of(F.col("status"), ["mismatch", "review"], 9)
    w = Window.partitionBy("rr_id")
    counted = decisions.select("*", *[F.count_if(F.col("status") == s).over(w).alias(f"n_{s}") for s in ("match", "review", "mismatch")])
    rows = counted.where(rank < 9)
    return rows.select("rr_id", F.row_number().over(w.orderBy(rank, "page")).alias("row_no"), "page", "status", "severity", F.array_join("all_diffs", "; ").alias("differences"), "n_match", "n_review", "n_mismatch")


def batch_status(findings: DataFrame, visual: DataFrame, results: DataFrame) -> DataFrame:
    """CRITICAL, FAIL, REVIEW or PASS of every result."""
    critical = findings.where(F.col("bucket").isin(K.CRITICAL_BUCKETS) & F.col("is_object") & (F.lower("severity") == "critical")).select("rr_id").distinct().withColumn("critical", F.lit(True))
    pages = page_decisions(findings, visual).groupBy("rr_id").agg(F.bool_or(F.col("status") == "mismatch").alias("mismatch"), F.bool_or(F.col("status") == "review").alias("review"))
    rows = results.select("rr_id").join(critical, "rr_id", "left").join(pages, "rr_id", "left")
    return rows.select("rr_id", F.when(F.col("critical"), "CRITICAL").when(F.col("mismatch"), "FAIL").when(F.col("review"), "REVIEW").otherwise("PASS").alias("batch_status"))


def batch_summary(statuses: DataFrame) -> DataFrame:
    """Counts by status over all results, and whether the batch fails."""
    s = F.col("batch_status")
    return statuses.agg(*[F.count_if(s == x).alias(x.lower()) for x in ("PASS", "REVIEW", "FAIL", "ERROR", "CRITICAL")], F.coalesce(F.bool_or(s.isin("CRITICAL", "FAIL", "ERROR")), F.lit(False)).alias("failed"))


def unclassified_major_pages(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """Major matched pages that no finding of nine buckets is on: one medium finding each."""
    covered = findings.where(F.col("bucket").isin(K.CLASSIFIED_BUCKETS) & F.col("is_object") & F.col("page").isNotNull()).select("rr_id", "page").distinct()
    rows = visual.where(F.col("major") & ~F.coalesce(F.lower("alignment_op"), F.lit("matched")).isin("deleted", "inserted")).where("page IS NOT NULL")
    first = rows.join(covered, ["rr_id", "page"], "left_anti").groupBy("rr_id", "page").agg(F.min_by("diff_pixels_pct", "row_no").alias("pct"))
    text = F.format_string("Significant visual difference detected on page %d (%.1f%% pixel diff) — not classified by LLM.", "page", F.coalesce("pct", F.lit(0.0)))
    return first.select("rr_id", "page", F.lit("visual_mismatches").alias("bucket"), F.lit("medium").alias("severity"), text.alias("description"))


def page_flags(findings: DataFrame) -> DataFrame:
    """Per page: does a finding speak of a signature, is one a business issue, how many are there."""
    rows = findings.where(F.col("bucket").isin([b for b, _, _ in K.ISSUE_BUCKETS]) & F.col("is_object") & F.col("page").isNotNull())
    return rows.groupBy("rr_id", "page").agg(F.bool_or(S.signature_like(F.col("field"), F.col("description"), F.col("severity"))).alias("signature_like"), F.bool_or(F.col("bucket").isin(K.BUSINESS_BUCKETS)).alias("business_issue"), F.count(F.lit(1)).alias("items"))


def findings_by_page(findings: DataFrame) -> DataFrame:
    """Findings of eleven buckets as one ordered list per page."""
    rows = findings.where(F.col("bucket").isin(K.PAGE_BUCKETS) & F.col("is_object") & F.col("page").isNotNull()).withColumn("bucket_order", S.rank_of(F.col("bucket"), K.PAGE_BUCKETS, 99))
    return rows.groupBy("rr_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket_order", "bucket_pos", "bucket"))), lambda x: x["bucket"]).alias("buckets"))


def reconcile_visual(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """Findings that visual evidence adds: a note on deleted pages, inserted pages, signatures that seem to be
    missing, and differences on pages without any finding.

    Inside a page the first row that qualifies adds its finding and blocks the later ones: a signature finding
    needs a page that does not speak of signatures yet, a difference needs a page without findings."""
    visual = visual.withColumn("op", F.lower(F.coalesce("alignment_op", F.lit("matched"))))
    deleted = visual.where("op = 'deleted' AND page IS NOT NULL").groupBy("rr_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    totals = visual.groupBy("rr_id").agg(F.coalesce(F.max(F.when(F.col("op") != "inserted", F.col("page"))), F.lit(0)).alias("base"), F.coalesce(F.max(F.when(F.col("op") != "deleted", F.col("page"))), F.lit(0)).alias("now"))
    count_text = F.format_string(
        "Page count changed: baseline has %d page(s), current has %d page(s). Baseline page(s) %s have no direct counterpart in the current PDF — content may have been consolidated, reformatted, or genuinely removed. Review the matched pages for content differences.",
        "base", "now", F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "),
    )
    shape = lambda df, bucket, page, severity, text: df.select("rr_id", F.lit(bucket).alias("bucket"), page.cast("int").alias("page"), severity.alias("severity"), text.alias("description"))
    counted = shape(deleted.join(totals, "rr_id"), "structural_changes", F.lit(None), F.lit("high"), count_text)
    blank = F.coalesce(F.col("is_blank_page"), F.lit(False)) if "is_blank_page" in visual.columns else F.lit(False)
    inserted = shape(
        visual.where("op = 'inserted' AND page IS NOT NULL"), "extra_content", F.col("page"), F.when(blank, "low").otherwise("high"),
        F.when(blank, F.format_string("Page %d of the current PDF is a blank page with no counterpart in the baseline — likely an intentional separator or placeholder.", "page"))
        .otherwise(F.format_string("Page %d of the current PDF has no counterpart in the baseline — this is an extra / inserted page with content.", "page")),
    )
    rows = visual.where("op NOT IN ('deleted', 'inserted') AND page IS NOT NULL").join(page_flags(findings), ["rr_id", "page"], "left")
    sim = F.coalesce("similarity", F.lit(1.0))
    confidence = F.lower(F.coalesce("signature_confidence", F.lit("none"))) if "signature_confidence" in visual.columns else F.lit("high")
    label = F.coalesce("signature_label", F.lit("signature")) if "signature_label" in visual.columns else F.lit("signature")
    signature = F.col("signature_candidate") & confidence.isin("high", "medium") & (sim <= K.SIGNATURE_SIMILARITY) & ~F.coalesce("signature_like", F.lit(False))
    indent_only = F.lit(False)
    if "formatting_summary" in visual.columns:
        told = F.lower(F.coalesce("formatting_summary", F.lit("")))
        indent_only = ~F.coalesce("has_text_changes", F.lit(False)) & F.coalesce("has_formatting_changes", F.lit(False)) & told.contains("indented") & ~told.contains("bold")
    differs = (F.col("major") | F.col("warn")) & (sim <= K.REVIEW_SIMILARITY) & F.col("items").isNull() & ~indent_only
    pattern = F.col("change_pattern")
    zones = F.col("changed_zones") if "changed_zones" in visual.columns else F.array().cast("array<string>")
    severity = F.when(pattern == "page_wide", "low").when(pattern == "header_only", "medium").when(pattern == "footer_area", "high").when(F.col("warn"), "medium").otherwise("high")
    shown = F.format_string("%.3f", sim)
    text = (
        F.when(pattern == "page_wide", F.concat(F.lit("Page-wide rendering difference (similarity="), shown, F.lit(", "), F.format_string("%.1f", F.coalesce("diff_pixels_pct", F.lit(0.0))), F.lit("% pixels differ). Changes are spread across the entire page, which typically indicates a font rendering, watermark, or DPI difference rather than a content change. Review the visual snapshot to confirm.")))
        .when(pattern == "header_only", F.concat(F.lit("Header area changed (similarity="), shown, F.lit("). Check policy number, effective date, named insured, or logo in the page header.")))
        .when(pattern == "footer_area", F.concat(F.lit("Footer/signature area changed (similarity="), shown, F.lit("). Check signature blocks, footer dates, and footer text.")))
        .when(F.size(zones) > 0, F.trim(F.concat(F.lit("Visual difference in "), F.array_join(zones, ", "), F.lit(" (similarity="), shown, F.lit("). "), S.change_hint(pattern, zones))))
        .otherwise(F.concat(F.lit("Visual difference detected (similarity="), shown, F.lit(").")))
    )
    kind = F.when(F.coalesce(signature, F.lit(False)), "signature").when(F.coalesce(differs, F.lit(False)), "difference")
    chosen = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("rr_id", "page").orderBy("row_no"))).where("nth = 1")
    signed = shape(chosen.where("kind = 'signature'"), "missing_content", F.col("page"), F.when(confidence == "high", "high").otherwise("medium"), F.concat(F.lit("Possible missing or changed signature near "), label, F.lit(".")))
    other = shape(chosen.where("kind = 'difference'"), "visual_mismatches", F.col("page"), severity, text)
    return counted.unionByName(inserted).unionByName(signed).unionByName(other)
