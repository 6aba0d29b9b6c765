"""Reports: KPIs, latest rows, trends, visibility, exports, ingest checks, schedules and webhooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formcheck.constants import STUCK_MINUTES
from formcheck.functions import scalars as S


# File names of a result's folder, by the column that tells whether there is one.
BUNDLE_FILES = [("result_json", "findings.json"), ("report_html_path", "report.html"), ("form_path", "tested_form.pdf"), ("benchmark_path", "golden_copy.pdf")]


def visible_projects(projects: DataFrame, members: DataFrame, user_id: int, is_admin: bool) -> DataFrame:
    """Admins see all projects, others those they belong to."""
    return projects if is_admin else projects.join(members.where(F.col("user_id") == user_id), "project_id", "left_semi")


def active_reviewers(members: DataFrame) -> DataFrame:
    return members.where(F.col("role").isin("admin", "reviewer")).select("user_id", "role").distinct()


def members_by_project(projects: DataFrame, members: DataFrame) -> DataFrame:
    lists = members.groupBy("project_id").agg(F.array_sort(F.collect_set("user_id")).alias("users"))
    return projects.join(lists, "project_id", "left").select("project_id", F.coalesce("users", F.array().cast("array<bigint>")).alias("users"))


def runs_since(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return runs.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days))).agg(F.count(F.lit(1)).alias("runs"))


def expire_stuck_results(results: DataFrame, now: Column, minutes: int = STUCK_MINUTES) -> DataFrame:
    """Results that run for longer than the limit are failed, with a message."""
    stuck = (F.col("run_state") == "running") & (F.col("created_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return results.select("rr_id", F.when(stuck, "failed").otherwise(F.col("run_state")).alias("run_state"), F.when(stuck, f"no result after {minutes} minutes").alias("error_message"))


def rerun_candidates(results: DataFrame, run_states: list[str]) -> DataFrame:
    """Test cases with a result in one of the states, per run."""
    return results.where(F.col("run_state").isin(run_states)).select("run_id", "test_case_id").distinct()


def due_schedules(schedules: DataFrame, test_cases: DataFrame, now: Column) -> DataFrame:
    """Test cases of active schedules that are due; the id list keeps digits only, and cases must be of the
    schedule's project."""
    due = schedules.where(F.col("is_active") & (F.col("next_run_at") <= now))
    ids = due.select("schedule_id", "project_id", F.explode(S.csv_tokens(F.col("testcase_ids"))).alias("id")).where(F.col("id").rlike(r"^\d+$"))
    return ids.select("schedule_id", "project_id", F.col("id").cast("long").alias("test_case_id")).join(test_cases.select("test_case_id", "project_id"), ["test_case_id", "project_id"])


def match_webhooks(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Event x active endpoint of its project whose list names the event, with the payload to send."""
    own = hooks.where("is_active").select("hook_id", "project_id", "url", S.csv_tokens(F.col("events")).alias("names"))
    payload = F.to_json(F.struct(F.col("action").alias("event"), "project_id", F.col("detail").alias("payload")))
    return events.join(own, "project_id").where(F.array_contains("names", F.col("action"))).select("id", "hook_id", "url", "action", payload.alias("payload"))


def last_run_per_project(projects: DataFrame, runs: DataFrame) -> DataFrame:
    last = runs.groupBy("project_id").agg(F.max_by(F.struct("run_id", "status"), F.struct("created_at", "run_id")).alias("last"))
    return projects.join(last, "project_id", "left").select("project_id", F.col("last.run_id").alias("last_run_id"), F.col("last.status").alias("last_status"))


def latest_result_per_test_case(results: DataFrame) -> DataFrame:
    """By the largest id, not by time; partial aggregation, no window."""
    return results.groupBy("test_case_id").agg(F.max("rr_id").alias("rr_id"), F.max_by("created_at", "rr_id").alias("created_at"), F.max_by("project_id", "rr_id").alias("project_id"))


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("project_id", "run_id", "nth")


def test_case_trend(results: DataFrame, metrics: DataFrame, per_case: int = 30, per_project: int = 60) -> DataFrame:
    """The first per_case results of each case by time; of these the per_project newest of each project."""
    rows = results.join(metrics.select("rr_id", (F.col("errors") + F.col("warnings")).alias("obs")), "rr_id")
    case = Window.partitionBy("test_case_id").orderBy("created_at", "rr_id")
    project = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("created_at"), "rr_id")
    first = rows.withColumn("nth", F.row_number().over(case)).where(F.col("nth") <= per_case)
    return first.withColumn("newest", F.row_number().over(project)).where(F.col("newest") <= per_project).select("project_id", "test_case_id", "rr_id", "nth", "newest", "obs")


def trend_filter(trend: DataFrame, test_case_id: int | None = None, status: str | None = None) -> DataFrame:
    """Trend rows of a test case and/or status, and their number."""
    if test_case_id is not None:
        trend = trend.where(F.col("test_case_id") == test_case_id)
    if status is not None:
        trend = trend.where(F.col("status") == status)
    return trend


def prev_next_result(results: DataFrame) -> DataFrame:
    """Neighbours of each result within its run."""
    w = Window.partitionBy("run_id").orderBy("rr_id")
    return results.select("rr_id", "run_id", F.lag("rr_id").over(w).alias("prev_id"), F.lead("rr_id").over(w).alias("next_id"), F.row_number().over(w).alias("position"), F.count(F.lit(1)).over(Window.partitionBy("run_id")).alias("total"))


def home_kpis(run_totals: DataFrame, last: int = 20) -> DataFrame:
    """Pass rate over the newest completed runs, open findings over all of them. One row."""
    done = run_totals.where("status = 'completed'")
    recent = done.orderBy(F.desc("created_at"), F.desc("run_id")).limit(last).select("total", "passed", F.lit(0).alias("errors"))
    sums = recent.unionByName(done.select(F.lit(0).alias("total"), F.lit(0).alias("passed"), "errors")).agg(*[F.sum(c).alias(c) for c in ("total", "passed", "errors")])
    rate = F.when(F.coalesce("total", F.lit(0)) > 0, F.bround(F.col("passed") / F.col("total") * 100, 0)).otherwise(0).cast("int")
    return sums.select(rate.alias("pass_rate"), F.coalesce("errors", F.lit(0)).alias("open_findings"))


def project_kpis(projects: DataFrame, results: DataFrame, run_totals: DataFrame) -> DataFrame:
    """Forms, test cases, runs and pass rate (passed / (passed + errors)) of each project."""
    counts = results.groupBy("project_id").agg(F.count_distinct("form_id").alias("forms"), F.count_distinct("test_case_id").alias("test_cases"))
    runs = run_totals.groupBy("project_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("passed").alias("p"), F.sum("errors").alias("e"))
    rows = projects.select("project_id").join(counts, "project_id", "left").join(runs, "project_id", "left").fillna(0)
    checks = F.col("p") + F.col("e")
    return rows.select("project_id", "forms", "test_cases", "runs", F.when(checks > 0, F.bround(F.col("p") / checks * 100, 0)).otherwise(0).cast("int").alias("pass_rate"))


def defect_keys_by_test_case(results: DataFrame, reviews: DataFrame) -> DataFrame:
    keys = reviews.where("issue_key IS NOT NULL").join(results.select("rr_id", "test_case_id"), "rr_id")
    return keys.groupBy("test_case_id").agg(F.array_sort(F.collect_set("issue_key")).alias("keys"))


def test_case_summary(results: DataFrame, metrics: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per test case: its latest result, counts by review, pending, total and issue keys over all its results."""
    latest = latest_result_per_test_case(results).join(metrics.select("rr_id", "errors", "warnings", "status"), "rr_id")
    counts = reviews.groupBy("rr_id").agg(F.count_if(F.col("status") == "false_positive").alias("passed_findings"), F.count_if(F.col("status") == "resolved").alias("defects"))
    rows = latest.join(counts, "rr_id", "left").fillna(0, ["passed_findings", "defects"]).withColumn("pending", F.col("errors") + F.col("warnings"))
    rows = rows.withColumn("total", F.col("pending") + F.col("passed_findings") + F.col("defects")).join(defect_keys_by_test_case(results, reviews), "test_case_id", "left")
    return rows.select("test_case_id", "project_id", "rr_id", "status", "passed_findings", "defects", "pending", "total", F.coalesce(F.array_join("keys", ","), F.lit("")).alias("keys"))


def project_dashboard(summary: DataFrame) -> DataFrame:
    s = F.col("status")
    return summary.groupBy("project_id").agg(F.sum("defects").alias("open_defects"), F.sum("pending").alias("pending"), *[F.count_if(s == x).alias(x) for x in ("passed", "failed", "in_review")])


def form_dependants(results: DataFrame) -> DataFrame:
    rows = results.select("project_id", "form_id", "test_case_id").distinct()
    return rows.groupBy("project_id", "form_id").agg(F.array_sort(F.collect_list("test_case_id")).alias("test_cases"))


def delete_blockers(results: DataFrame) -> DataFrame:
    """Forms that test cases use: the first three names, "and N more"."""
    lists = form_dependants(results)
    names = F.array_join(F.transform(F.slice("test_cases", 1, 3), lambda x: F.concat(F.lit("TC "), x.cast("string"))), ", ")
    more = F.when(F.size("test_cases") > 3, F.concat(F.lit(" and "), (F.size("test_cases") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return lists.select("project_id", "form_id", F.concat(names, more).alias("used_by"))


def cascade_delete(results: DataFrame, reviews: DataFrame, comments: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """Tables without the runs in doomed(run_id) and all that hangs on them."""
    kept = results.join(doomed, "run_id", "left_anti")
    kept_reviews = reviews.join(kept.select("rr_id"), "rr_id", "left_semi")
    return {"results": kept, "reviews": kept_reviews, "comments": comments.join(kept.select("rr_id"), "rr_id", "left_semi")}


def global_totals(projects: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    keys = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("key")).distinct()
    rows = keys(projects, "projects", "project_id").union(keys(runs, "runs", "run_id")).union(keys(results, "forms", "form_id"))
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("projects", "runs", "forms")])


def accessibility_counts(findings: DataFrame) -> DataFrame:
    return findings.where("bucket = 'accessibility_issues'").groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count(F.lit(1)).alias("issues"))


def enrich_results(results: DataFrame, projects: DataFrame) -> DataFrame:
    """Results with the names of project and test case, and their fallbacks."""
    rows = results.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")
    return rows.select("rr_id", "run_id", F.coalesce("project_name", F.lit("Unknown")).alias("project_name"), F.concat(F.lit("tc_"), F.col("test_case_id").cast("string")).alias("test_case_name"))


def audit_recent(audit: DataFrame, per_project: int = 200) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    return audit.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_project)


def export_audit_rows(audit: DataFrame, limit: int = 500) -> DataFrame:
    """The newest rows of each project with eight fixed columns, ready for CSV, and the project they belong to; a column that
    the log lacks is null."""
    have = lambda c: F.col(c).cast("string") if c in audit.columns else F.lit(None).cast("string")
    when = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return audit_recent(audit, limit).select("id", "action", *[have(c).alias(c) for c in ("resource_type", "resource_id", "username", "user_ip")], when.alias("created_at"), have("detail").alias("detail"), F.col("project_id").cast("string").alias("project_id"))


def append_audit_rows(actions: DataFrame) -> DataFrame:
    """One audit row per action: user `system` by default, detail as JSON."""
    return actions.select(F.coalesce(F.nullif("username", F.lit("")), F.lit("system")).alias("username"), "action", "project_id", F.when(F.col("detail").isNotNull(), F.to_json(F.struct("detail"))).alias("detail"), "created_at")


def evidence_files(results: DataFrame) -> DataFrame:
    """results(rr_id, test_case_id and, where known, result_json, report_html_path, form_path, benchmark_path,
    visual_diff_images as a JSON list) -> (rr_id, path): the files of each result's folder in the bundle."""
    folder = F.concat(F.lit("results/result_"), F.col("rr_id").cast("string"), F.lit("_tc_"), F.col("test_case_id").cast("string"), F.lit("/"))
    present = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != "" if c in results.columns else F.lit(False)
    single = [F.when(present(c), F.concat(folder, F.lit(name))) for c, name in BUNDLE_FILES]
    images = F.from_json("visual_diff_images", "array<string>") if "visual_diff_images" in results.columns else F.array().cast("array<string>")
    shown = F.transform(F.array_compact(F.coalesce(images, F.array().cast("array<string>"))), lambda x: F.concat(folder, F.lit("visual_diffs/"), x))
    return results.select("rr_id", F.explode(F.concat(F.array_compact(F.array(*single)), shown)).alias("path"))


def evidence_manifest(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """One nested document per run: header and list of results, each with the files of its folder."""
    files = evidence_files(results).groupBy("rr_id").agg(F.array_sort(F.collect_list("path")).alias("files"))
    rows = results.select("rr_id", "run_id", "test_case_id").join(metrics, "rr_id").join(files, "rr_id", "left")
    item = F.struct("rr_id", F.concat(F.lit("tc_"), F.col("test_case_id").cast("string")).alias("test_case"), "status", "errors", "warnings", F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    lists = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    n_files = F.aggregate("results", F.lit(0), lambda n, x: n + F.size(x["files"]))
    return lists.select("run_id", F.size("results").alias("n_results"), n_files.alias("n_files"), F.to_json(F.struct("run_id", "results")).alias("document"))
