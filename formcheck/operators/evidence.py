"""Visual evidence beside findings: older reconciliation rules, row categories, snapshots, golden copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formcheck import constants as K
from formcheck.functions import scalars as S
from formcheck.operators.findings import issue_rows, page_flags

# Words of a note that tell a category.
SIGNATURE_HINTS = "signature|president|secretary|authorized|signed|approval"
LAYOUT_HINTS = "layout|table|misaligned|alignment|shift|moved"
FOOTER_HINTS = "footer|header|pagination|page|page numbering"


def reconcile_visual_batch(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """Older rules: each deleted page is a critical missing content, each inserted page a critical extra one; a
    signature candidate counts at any similarity; a difference needs a page without findings. A signature under
    the tight threshold blocks what follows on its page; rows of a page are otherwise independent."""
    rows = visual.withColumn("op", F.lower(F.coalesce("alignment_op", F.lit("matched")))).where("page IS NOT NULL")
    shape = lambda df, bucket, severity: df.select("rr_id", F.lit(bucket).alias("bucket"), "page", F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"))
    deleted, inserted = shape(rows.where("op = 'deleted'"), "missing_content", "critical"), shape(rows.where("op = 'inserted'"), "extra_content", "critical")
    own = rows.where("op NOT IN ('deleted', 'inserted')").join(page_flags(findings), ["rr_id", "page"], "left")
    sim = F.coalesce("similarity", F.lit(1.0))
    signed = F.col("signature_candidate") & ~F.coalesce("signature_like", F.lit(False))
    differs = (F.col("major") | F.col("warn")) & (sim <= K.REVIEW_SIMILARITY) & F.col("items").isNull() & ~(signed & (sim <= K.SIGNATURE_SIMILARITY))
    return deleted.unionByName(inserted).unionByName(shape(own.where(signed), "missing_content", "high")).unionByName(shape(own.where(differs), "visual_mismatches", F.when(F.col("warn"), "medium").otherwise("high")))


def infer_visual_category(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """(rr_id, row_no, category, severity) of each visual row: from the gravest finding of its page that tells a
    category, else from the words of its note, else from its flags."""
    issues = issue_rows(findings).where("page IS NOT NULL")
    told = F.lower(F.concat_ws(" ", "field", "description"))
    category = (
        F.when(F.col("bucket") == "value_mismatches", "Value difference|critical")
        .when((F.col("bucket") == "missing_content") & told.rlike(SIGNATURE_HINTS), "Signature / approval block|high")
        .when(F.col("bucket") == "missing_content", "Missing content|high").when(F.col("bucket") == "extra_content", "Extra content|medium")
        .when(F.col("bucket") == "layout_anomalies", "Layout difference|medium")
    )
    key = F.struct(S.severity_rank(F.col("severity")).alias("rank"), "bucket_order", "bucket_pos")
    strongest = issues.withColumn("told", category).where("told IS NOT NULL").groupBy("rr_id", "page").agg(F.min_by("told", key).alias("told"))
    note = F.lower(F.trim(F.coalesce("note", F.lit("")))) if "note" in visual.columns else F.lit("")
    inferred = (
        F.when(note.rlike(SIGNATURE_HINTS), "Signature / approval block|high").when(note.rlike(LAYOUT_HINTS), "Layout difference|medium").when(note.rlike(FOOTER_HINTS), "Header / footer / pagination|low")
        .when(F.col("major"), "Visual difference|high").when(F.col("warn"), "Visual difference|medium").otherwise("No material difference|low")
    )
    out = F.split(F.coalesce("told", inferred), r"\|")
    return visual.join(strongest, ["rr_id", "page"], "left").select("rr_id", "row_no", out[0].alias("category"), out[1].alias("severity"))


def observation_snapshots(observations: DataFrame, visual: DataFrame) -> DataFrame:
    """observations(rr_id, obs_no, page) with the snapshot of the last visual row of their page; the page is the one in
    the current document where known. Rows without a snapshot do not count."""
    page = F.coalesce("actual_page_num", "page") if "actual_page_num" in visual.columns else F.col("page")
    rows = visual.where(F.coalesce("snapshot_path", F.lit("")) != "").withColumn("own", page).where("own IS NOT NULL")
    last = rows.groupBy("rr_id", F.col("own").alias("page")).agg(F.max_by("snapshot_path", "row_no").alias("snapshot_path"))
    return observations.join(last, ["rr_id", "page"], "left")


def form_and_golden(test_cases: DataFrame, forms: DataFrame) -> DataFrame:
    """Test cases with the names of their form and of its golden copy, and the reason why one cannot run."""
    side = lambda key, name: forms.select(F.col("form_id").alias(key), F.col("name").alias(name))
    rows = test_cases.join(side("form_id", "form_name"), "form_id", "left").join(side("benchmark_form_id", "golden_name"), "benchmark_form_id", "left")
    reason = F.when(F.col("form_name").isNull(), "form is missing").when((F.col("mode") == "benchmark") & F.col("golden_name").isNull(), "golden copy is missing")
    return rows.select("test_case_id", "form_name", "golden_name", reason.alias("reason"))


def pages_union(findings: DataFrame, visual: DataFrame) -> DataFrame:
    """Distinct pages of findings and visual rows."""
    return issue_rows(findings).select("rr_id", "page").union(visual.select("rr_id", "page")).where("page IS NOT NULL").distinct()


def chips(rows: DataFrame, severity: Column, status: Column) -> DataFrame:
    return rows.select("*", S.severity_chip_class(severity).alias("severity_class"), S.status_chip_class(status).alias("status_class"))
