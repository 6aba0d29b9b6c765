"""Reviews: joining verdicts to findings, recomputing metrics, false-positive patterns, gates, defects.

reviews(rr_id, finding_index, status, issue_key): at most one row per numbered finding.
patterns(pattern_id, project_id, form_id, category, match_mode, pattern, is_active).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from formcheck import constants as K
from formcheck.functions import scalars as S
from formcheck.operators.findings import number_findings


def findings_with_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Numbered findings with their review; without one a finding is open."""
    own = reviews.select("rr_id", "finding_index", F.col("status").alias("review_status"), "issue_key")
    return number_findings(findings).join(own, ["rr_id", "finding_index"], "left").withColumn("review_status", F.coalesce("review_status", F.lit("open")))


def review_stats(findings: DataFrame, reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: findings, pending, confirmed defects, no issue."""
    s = F.col("review_status")
    per = findings_with_reviews(findings, reviews).groupBy("rr_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "resolved").alias("defects"), F.count_if(s == "false_positive").alias("no_issue"))
    rows = results.select("rr_id", "run_id").join(per, "rr_id", "left").fillna(0, ["total", "defects", "no_issue"])
    sums = rows.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("total", "defects", "no_issue")])
    return sums.withColumn("pending", F.col("total") - F.col("defects") - F.col("no_issue"))


def recompute_after_review(findings: DataFrame, reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Per result after reviews: errors are confirmed defects, warnings are pending findings, and the verdict."""
    s = F.col("review_status")
    per = findings_with_reviews(findings, reviews).groupBy("rr_id").agg(F.count_if(s == "resolved").alias("errors"), F.count_if(~s.isin("resolved", "false_positive")).alias("warnings"))
    rows = results.select("rr_id", "run_id").join(per, "rr_id", "left").fillna(0, ["errors", "warnings"])
    status = F.when(F.col("warnings") > 0, "in_review").when(F.col("errors") > 0, "failed").otherwise("passed")
    return rows.select("rr_id", "run_id", "errors", "warnings", status.alias("status"), F.when(status == "passed", 1).otherwise(0).alias("passed"))


def review_status_pivot(reviews: DataFrame) -> DataFrame:
    """Reviews of a result by status."""
    return reviews.groupBy("rr_id").pivot("status", ["open", "in_review", "resolved", "false_positive"]).count().fillna(0)


def valid_patterns(patterns: DataFrame) -> DataFrame:
    """Active patterns; a regular expression that does not compile never matches, so it is left out before the
    join (it would fail the job there). The engine that matches also tests; named groups in the form (?P<name>...) and
    (?P=name) are put into its own form first."""
    active = patterns.where("is_active").withColumn("pattern", F.coalesce("pattern", F.lit("")))
    own = F.regexp_replace(F.regexp_replace("pattern", r"\(\?P<", "(?<"), r"\(\?P=(\w+)\)", r"\\k<$1>")
    active = active.withColumn("pattern", F.when(F.col("match_mode") == "regex", own).otherwise(F.col("pattern")))
    return active.where((F.coalesce("match_mode", F.lit("")) != "regex") | S.compiles(F.concat(F.lit("(?i)"), F.col("pattern"))))


#: `contains` patterns of one automaton, and findings of a project in one part of it, about.
AUTOMATON, PART = 50_000, 200_000


def contains_hits(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(rr_id, bucket, bucket_pos, pattern_id): for each finding the least of the patterns that its text contains. rows(rr_id,
    bucket, bucket_pos, project_id, form_id, told) and patterns(pattern_id, project_id, pattern_form, category, pattern);
    texts and patterns of one case, no pattern empty.

    A project's patterns become automata (Aho-Corasick), one for each AUTOMATON of them; a text goes through each once, so
    the work grows with the texts and with what is found in them, not with the number of patterns. Both sides are
    dealt by project, automaton and part, the patterns first in each: a task holds one automaton at a time. A
    project with very many findings has several parts, each with its own copy of the patterns."""
    scoped = patterns.groupBy("project_id", "pattern_form", "category", "pattern").agg(F.min("pattern_id").alias("pattern_id"))
    automata = scoped.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / AUTOMATON).cast("int").alias("automata"))
    sizes = rows.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).join(automata, "project_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    found_key, text_key = ["rr_id", "bucket", "bucket_pos"], ["project_id", "automaton", "part"]
    part = F.pmod(F.xxhash64(*found_key), F.col("parts")).cast("int")
    texts = rows.join(sizes, "project_id").withColumn("part", part).withColumn("automaton", each(F.col("automata")))
    entry = F.struct("pattern", "pattern_id", "pattern_form", "category")
    dealt = scoped.join(sizes, "project_id").withColumn("automaton", F.pmod(F.xxhash64("pattern"), F.col("automata")).cast("int"))
    lists = dealt.groupBy("project_id", "automaton", "parts").agg(F.collect_list(entry).alias("patterns")).withColumn("part", each(F.col("parts")))
    texts = texts.select(*text_key, F.lit(1).alias("order"), *found_key, "form_id", "told", F.lit(None).cast(lists.schema["patterns"].dataType).alias("patterns"))
    both = lists.select(*text_key, F.lit(0).alias("order"), *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in (*found_key, "form_id", "told")), "patterns").unionByName(texts)
    kinds = {c: texts.schema[c].dataType.simpleString() for c in found_key} | {"pattern_id": patterns.schema["pattern_id"].dataType.simpleString()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            order, told, form, bucket = (batch.column(c).to_pylist() for c in ("order", "told", "form_id", "bucket"))
            for k in range(batch.num_rows):
                if order[k] == 0:
                    automaton = _automaton(batch.column("patterns")[k].as_py())
                    continue
                best = None
                for _, entries in automaton.iter(told[k]):
                    for pattern_id, pattern_form, category in entries:
                        fits = (not category or category == bucket[k]) and (pattern_form is None or (form[k] not in (None, 0) and pattern_form == form[k]))
                        if fits and (best is None or pattern_id < best):
                            best = pattern_id
                if best is not None:
                    out[0].append(k)
                    out[1].append(best)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(out[0], pa.int32())) for c in found_key), pa.array(out[1], spark_type)], [*found_key, "pattern_id"])

    spark_type = to_arrow_type(patterns.schema["pattern_id"].dataType)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, *text_key).sortWithinPartitions(*text_key, "order")
    hits = ordered.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    return hits.groupBy(*found_key).agg(F.min("pattern_id").alias("pattern_id"))


def _automaton(patterns: list[dict]) -> ahocorasick.Automaton:
    """Automaton of pattern texts; the value of each is its (pattern_id, form, category), least id first."""
    values: dict[str, list[tuple]] = {}
    for p in patterns:
        values.setdefault(p["pattern"], []).append((p["pattern_id"], p["pattern_form"], p["category"]))
    automaton = ahocorasick.Automaton()
    for pattern, entries in values.items():
        automaton.add_word(pattern, sorted(entries, key=lambda e: e[0]))
    automaton.make_automaton()
    return automaton


def judged_findings(findings: DataFrame, active: DataFrame, results: DataFrame, told: Column) -> DataFrame:
    """(rr_id, bucket, bucket_pos, told, project_id, form_id): the findings of review buckets whose project has a pattern."""
    # Only findings of projects that have patterns go on: they are sought by their results first, before texts are made and travel.
    judged = results.select("rr_id", "project_id", "form_id").join(active.select("project_id").distinct(), "project_id", "left_semi")
    findings = findings.join(judged.select("rr_id"), "rr_id", "left_semi").where(F.col("bucket").isin(K.REVIEW_BUCKETS))
    return findings.select("rr_id", "bucket", "bucket_pos", told).join(judged, "rr_id")


def pattern_hits(findings: DataFrame, patterns: DataFrame, results: DataFrame) -> DataFrame:
    """(rr_id, bucket, bucket_pos, pattern_id): for each finding of a review bucket that a pattern of its project
    matches, the first pattern. Matching ignores case; an empty category fits all buckets, a null form all forms.

    Texts that contain a pattern are found by automata (contains_hits). The others are joined on the project and a key: an
    exact pattern meets the findings of its text's hash, an expression those of its category, or all of the project
    where it names none. The least pattern id is taken with partial aggregation."""
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("description", "text", "field_name") if c in findings.columns])
    active = valid_patterns(patterns)
    rows = judged_findings(findings, active, results, text.alias("told"))
    own = active.select("pattern_id", "project_id", F.col("form_id").alias("pattern_form"), "category", "match_mode", "pattern")
    within = F.coalesce("match_mode", F.lit("")).isin("exact", "regex") | (F.col("pattern") == "")
    inside = own.where(~within).withColumn("pattern", F.lower("pattern")).withColumn("category", F.coalesce("category", F.lit("")))
    own = own.where(within)
    scope = (F.coalesce("category", F.lit("")) == "") | (F.col("category") == F.col("bucket"))
    form = F.col("pattern_form").isNull() | ((F.coalesce("form_id", F.lit(0)) != 0) & (F.col("pattern_form") == F.col("form_id")))
    told, pattern = F.lower("told"), F.lower("pattern")
    hashed = lambda c: F.concat(F.lit("text:"), F.xxhash64(c).cast("string"))
    of = lambda c: F.concat(F.lit("bucket:"), c)
    keyed = rows.withColumn("key", F.explode(F.array(hashed(told), of(F.col("bucket")), of(F.lit("")))))
    own = own.withColumn("key", F.when(F.col("match_mode") == "exact", hashed(pattern)).otherwise(of(F.coalesce("category", F.lit("")))))
    # What is left beside these two is an empty pattern, which every text contains.
    match = F.when(F.col("match_mode") == "exact", told == pattern).when(F.col("match_mode") == "regex", F.regexp_like("told", F.concat(F.lit("(?i)"), F.col("pattern")))).otherwise(True)
    joined = keyed.join(own, ["project_id", "key"]).where(scope & form & match).select("rr_id", "bucket", "bucket_pos", "pattern_id")
    hits = joined.unionByName(contains_hits(rows.withColumn("told", told), inside))
    return hits.groupBy("rr_id", "bucket", "bucket_pos").agg(F.min("pattern_id").alias("pattern_id"))


def suppress_false_positives(findings: DataFrame, patterns: DataFrame, results: DataFrame) -> DataFrame:
    """The findings that no pattern matches."""
    return findings.join(pattern_hits(findings, patterns, results), ["rr_id", "bucket", "bucket_pos"], "left_anti")


def suppression_log(findings: DataFrame, patterns: DataFrame, results: DataFrame) -> DataFrame:
    """What each pattern took, a row for each result that it took findings of: in all results (suppressed), with those stored
    before (suppressed_count, where patterns have it), and what is logged of the result: its form and the items (category,
    description, cut at 120 characters) in the order of buckets and places. A pattern that took nothing has one row without
    a result. A list holds findings of one result only, so none grows with the table."""
    described = F.substring(F.coalesce("description", F.lit("")), 1, 120).alias("description")
    taken = judged_findings(findings, valid_patterns(patterns), results, described).join(pattern_hits(findings, patterns, results), ["rr_id", "bucket", "bucket_pos"])
    item = F.struct(S.rank_of(F.col("bucket"), K.REVIEW_BUCKETS, 99).alias("bucket_order"), "bucket_pos", F.col("bucket").alias("category"), "description")
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["category"].alias("category"), x["description"].alias("description")))
    log = taken.groupBy("pattern_id", "rr_id", "form_id").agg(items.alias("items"))
    stored = F.coalesce("suppressed_count", F.lit(0)) if "suppressed_count" in patterns.columns else F.lit(0)
    own = patterns.select("pattern_id", "project_id", "match_mode", F.substring(F.coalesce("pattern", F.lit("")), 1, 80).alias("pattern"), stored.cast("long").alias("stored"))
    counted = own.join(log.groupBy("pattern_id").agg(F.sum(F.size("items")).alias("suppressed")), "pattern_id", "left").fillna(0, ["suppressed"])
    counted = counted.withColumn("suppressed_count", F.col("stored") + F.col("suppressed")).drop("stored")
    # Each pattern stands in the log once without a result, so that the join is an inner one: the results of a pattern can be dealt to several tasks.
    rows = log.unionByName(own.select("pattern_id"), allowMissingColumns=True).join(counted, "pattern_id").where("rr_id IS NOT NULL OR suppressed = 0")
    return rows.select("pattern_id", "project_id", "match_mode", "pattern", "suppressed", "suppressed_count", "rr_id", "form_id", "items")


def learn_false_positives(reviewed: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns after learning. reviewed(project_id, category, description): findings judged false positives.
    The first 80 characters, trimmed, are the pattern; a known (project, category, pattern) becomes active
    again, a new one is added as `contains` for the whole project (pattern_id null until it is stored)."""
    text = F.trim(F.substring(F.coalesce("description", F.lit("")), 1, 80))
    learnt = reviewed.select("project_id", "category", text.alias("pattern")).where("pattern <> ''").distinct()
    key = ["project_id", "category", "pattern"]
    again = patterns.join(learnt, key, "left_semi").withColumn("is_active", F.lit(True))
    rest = patterns.join(learnt, key, "left_anti")
    new = learnt.join(patterns, key, "left_anti").select("*", F.lit("contains").alias("match_mode"), F.lit(True).alias("is_active"))
    return rest.unionByName(again).unionByName(new, allowMissingColumns=True)


def upsert_reviews(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Reviews after actions(rr_id, finding_index, action, issue_key, action_at): the latest action of a finding
    wins (of actions at one instant the greater status, the greater key), columns that it does not give keep their value."""
    status = F.when(F.col("action") == "assign", "in_review").when(F.col("action").isin("resolved", "false_positive", "open"), F.col("action")).otherwise("resolved")
    last = actions.groupBy("rr_id", "finding_index").agg(F.max_by(status, F.struct("action_at", status.alias("status"))).alias("new_status"), F.max_by(F.col("issue_key"), F.when(F.col("issue_key").isNotNull(), F.struct("action_at", "issue_key"))).alias("new_key"))
    joined = reviews.join(last, ["rr_id", "finding_index"], "full_outer")
    return joined.select("rr_id", "finding_index", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_key", "issue_key").alias("issue_key"))


def evaluate_gates(runs: DataFrame, stats: DataFrame, gates: DataFrame) -> DataFrame:
    """A run's gate, pending with the default limits where absent, and whether its limits are met."""
    own = gates.select("run_id", "max_errors_allowed", "max_warnings_allowed", "require_all_resolved", F.col("status").alias("gate_status"))
    rows = runs.join(own, "run_id", "left").join(stats.select("run_id", F.col("defects"), F.col("pending")), "run_id", "left").fillna(0, ["defects", "pending"])
    errors, warnings = F.coalesce("max_errors_allowed", F.lit(0)), F.coalesce("max_warnings_allowed", F.lit(5))
    met = (F.col("defects") <= errors) & (F.col("pending") <= warnings) & (~F.coalesce("require_all_resolved", F.lit(False)) | (F.col("pending") == 0))
    return rows.select("run_id", F.coalesce("gate_status", F.lit("pending")).alias("gate_status"), "defects", "pending", met.alias("met"))


def failure_cause(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Failed results: a confirmed defect, else the error text of the document."""
    defects = reviews.where("status = 'resolved'").select("rr_id").distinct().withColumn("defect", F.lit(True))
    error = F.get_json_object("result_json", "$.error") if "result_json" in results.columns else F.lit(None).cast("string")
    rows = results.where(F.col("run_state") == "failed").join(defects, "rr_id", "left")
    return rows.select("rr_id", F.when(F.col("defect"), "confirmed defects").otherwise(F.coalesce(F.nullif(error, F.lit("")), F.lit("unknown"))).alias("cause"))


def defect_rows(findings: DataFrame, reviews: DataFrame, results: DataFrame, names: DataFrame) -> DataFrame:
    """Ticket of each confirmed finding that has no issue yet: title and body. names(project_id, name)."""
    rows = findings_with_reviews(findings, reviews).where("review_status = 'resolved' AND issue_key IS NULL AND bucket <> 'observations'")
    rows = rows.join(results.select("rr_id", "run_id", "project_id"), "rr_id").join(names.select("project_id", F.col("name").alias("project")), "project_id", "left")
    title = F.initcap(F.replace("bucket", F.lit("_"), F.lit(" ")))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" (Page "), F.col("page").cast("string"), F.lit(")")))
    head = F.concat(F.lit("["), F.coalesce("project", F.lit("-")), F.lit("] "), title, F.lit(" - "), F.coalesce("field", F.lit("-")), F.coalesce(page, F.lit("")))
    lines = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in (("Run", "run_id"), ("Result", "rr_id"), ("Severity", "severity"), ("Description", "description"))]
    return rows.select("rr_id", "finding_index", head.alias("title"), F.concat_ws("\n", *lines).alias("body"))


def defect_status(reviews: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Status of each issue key of a comma-separated list; keys that the snapshot lacks are left out."""
    keys = reviews.where("issue_key IS NOT NULL").select("rr_id", "finding_index", F.explode(S.csv_tokens(F.col("issue_key"))).alias("issue_key"))
    return keys.join(snapshot, "issue_key")


def observation_findings(observations: DataFrame) -> DataFrame:
    """observations(rr_id, observation, confidence, current_page) as findings: severity by confidence."""
    page = S.safe_page(F.col("current_page"))
    return observations.select("rr_id", F.coalesce("observation", F.lit("")).alias("description"), S.observation_severity(F.col("confidence")).alias("severity"), page.alias("page"), F.nullif("current_page", F.lit("")).alias("field_name"))


def confidence_counts(observations: DataFrame) -> DataFrame:
    c = F.lower("confidence")
    return observations.groupBy("rr_id").agg(*[F.count_if(c == x).alias(x) for x in ("certain", "likely", "possible")])


def requirement_tags(reviews: DataFrame, requirements: DataFrame) -> DataFrame:
    """Reviews with the requirements named in their comma-separated compliance tags."""
    ids = reviews.select("rr_id", "finding_index", F.explode(S.csv_tokens(F.col("compliance_tags"))).alias("requirement_id"))
    return ids.join(requirements, "requirement_id")


def standard_requirements(standards: DataFrame, requirements: DataFrame) -> DataFrame:
    """standards(standard_id, code, name) with their requirements(requirement_id, standard_id, code, title, level); a
    standard without requirements has one row of nulls."""
    inner = requirements.select("standard_id", "requirement_id", F.col("code").alias("requirement_code"), "title", "level")
    return standards.select("standard_id", F.col("code").alias("standard_code"), "name").join(inner, "standard_id", "left")


def latest_review(actions: DataFrame, key: list[str], at: str, order: Column | None = None) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(at).desc(), *([order] if order is not None else []))
    return actions.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
