"""Findings: documents with odd shapes, numbering, decisions, suppression."""

import json

from formcheck.operators import findings as O
from formcheck.operators import reviews as R

FINDING = "rr_id long, bucket string, bucket_pos int, page int, severity string, field string, description string, is_object boolean"


def test_parse_odd_documents(spark):
    documents = [
        (1, json.dumps({"value_mismatches": [{"page": "2", "severity": "HIGH", "description": "d"}, "plain"], "spelling_errors": None, "missing_content": {"page": 3}, "observations": [{"observation": "o"}]})),
        (2, "not json"), (3, "[]"), (4, json.dumps({"extra_content": "one"})), (5, None),
    ]
    rows = {(r.rr_id, r.bucket, r.bucket_pos): r for r in O.parse_findings(spark.createDataFrame(documents, "rr_id long, result_json string")).collect()}
    assert set(rows) == {(1, "value_mismatches", 0), (1, "value_mismatches", 1), (1, "missing_content", 0), (1, "observations", 0), (4, "extra_content", 0)}
    assert rows[1, "value_mismatches", 0].page == 2 and rows[1, "value_mismatches", 0].severity == "high"
    assert not rows[1, "value_mismatches", 1].is_object and rows[1, "value_mismatches", 1].description == "plain"
    assert rows[1, "missing_content", 0].page == 3


def test_ocr_filter_reads_description(spark):
    rows = [(1, "value_mismatches", "Changed from 'premiurn' to 'premium'", None, None), (2, "value_mismatches", "Changed from '100' to '200'", None, None), (3, "layout_anomalies", "Changed from 'premiurn' to 'premium'", None, None), (4, "format_issues", "x", "premiurn", "premium")]
    kept = O.filter_ocr_artifacts(spark.createDataFrame(rows, "rr_id long, bucket string, description string, before string, after string"))
    assert sorted(r.rr_id for r in kept.collect()) == [2, 3]


def test_numbering_skips_and_counts(spark):
    rows = [(1, "visual_mismatches", 0, 1, "low", "f", "a", True), (1, "typography_issues", 0, 1, "low", "f", "b", True), (1, "spelling_errors", 0, 1, "low", "f", "c", True), (1, "observations", 0, 1, "low", "f", "d", False), (1, "observations", 1, 1, "low", "f", "e", True)]
    numbered = O.number_findings(spark.createDataFrame(rows, FINDING))
    assert sorted((r.finding_index, r.description) for r in numbered.collect()) == [(0, "c"), (1, "a"), (3, "e")]


def test_metrics_and_status(spark):
    rows = [(1, "observations", 0, 1, None, "f", "a", True), (1, "spelling_errors", 0, 1, None, "f", "a", True), (2, "extra_content", 0, 1, None, "f", "a", True)]
    results = spark.createDataFrame([(1,), (2,), (3,)], "rr_id long")
    out = {r.rr_id: (r.errors, r.warnings, r.passed, r.status) for r in O.result_status(O.derive_metrics(spark.createDataFrame(rows, FINDING), results)).collect()}
    assert out == {1: (1, 0, 0, "in_review"), 2: (0, 1, 1, "in_review"), 3: (0, 0, 1, "passed")}


def test_page_decisions(spark):
    findings = spark.createDataFrame([(1, "value_mismatches", 0, 2, "low", "f", "v", True), (1, "format_issues", 0, 3, "low", "f", "w", True)], FINDING)
    visual = "rr_id long, row_no int, page int, similarity double, diff_pixels_pct double, major boolean, warn boolean, signature_candidate boolean, alignment_op string, change_pattern string"
    rows = [(1, 1, 1, 0.9, 3.0, True, False, False, "matched", "x"), (1, 2, 2, 0.9, 3.0, True, False, True, "matched", "x"), (1, 3, 3, 0.9, 3.0, False, True, True, "matched", "x"), (1, 4, 4, 1.0, 0.0, False, False, False, "matched", "x")]
    out = {r.page: (r.status, r.severity, r.all_diffs) for r in O.page_decisions(findings, spark.createDataFrame(rows, visual)).collect()}
    assert out == {
        1: ("review", "medium", ["Significant visual difference detected."]), 2: ("mismatch", "low", ["v"]),
        3: ("review", "medium", ["w", "Signature-region change detected."]), 4: ("match", "low", []),
    }


def test_suppression_edges(spark):
    findings = spark.createDataFrame([(1, "value_mismatches", 0, 1, "low", "f", "Total differs", True), (2, "value_mismatches", 0, 1, "low", "f", "Other", True)], FINDING)
    results = spark.createDataFrame([(1, 10, 5), (2, 10, 6)], "rr_id long, project_id long, form_id long")
    patterns = spark.createDataFrame(
        [(3, 10, None, "", "contains", "total", True), (2, 10, None, "value_mismatches", "regex", "^TOTAL", True), (4, 10, None, "", "regex", "(", True), (5, 10, 5, "", "exact", "other", True), (6, 11, None, "", "contains", "o", True), (7, 10, None, "", "contains", "other", False)],
        "pattern_id long, project_id long, form_id long, category string, match_mode string, pattern string, is_active boolean",
    )
    hits = R.pattern_hits(findings, patterns, results).collect()
    assert [(h.rr_id, h.pattern_id) for h in hits] == [(1, 2)]
    kept = R.suppress_false_positives(findings, patterns, results).collect()
    assert [k.rr_id for k in kept] == [2]


def test_patterns_that_do_not_compile_match_nothing(spark):
    from formcheck.operators import reviews

    findings = spark.createDataFrame([(1, "format_issues", 0, "abc here"), (1, "format_issues", 1, "other")], "rr_id int, bucket string, bucket_pos int, description string")
    results = spark.createDataFrame([(1, 1, 1)], "rr_id int, project_id int, form_id int")
    told = [(k, 1, None, None, "regex", p, True) for k, p in enumerate(["(", "(?P<x>abc)", "[z-a]", "(?P<y>o)the(?P=y)"])]
    patterns = spark.createDataFrame(told, "pattern_id int, project_id int, form_id int, category string, match_mode string, pattern string, is_active boolean")
    assert [(r.bucket_pos, r.pattern_id) for r in reviews.pattern_hits(findings, patterns, results).collect()] == [(0, 1)]


def test_description_falls_back(spark):
    from formcheck.operators import findings as O

    told = '{"missing_content": [{"details": "d"}, {"reason": "r"}, {"note": "n"}, {"evidence": "e"}, {"description": "", "note": "x"}, {}]}'
    rows = O.issue_rows(O.parse_findings(spark.createDataFrame([(1, told)], "rr_id int, result_json string"))).orderBy("bucket_pos").collect()
    assert [r.description for r in rows] == ["d", "r", "n", "e", "x", "Missing content"]


def test_contained_patterns_by_automata(spark, monkeypatch):
    """Many patterns and one project with most findings, in several automata and parts, against every pattern in turn."""
    monkeypatch.setattr(R, "AUTOMATON", 7)
    monkeypatch.setattr(R, "PART", 20)
    words = ["stamp", "Footer", "page", "æøå", "x", "(see", "a.b", "page footer", "STAMP", ""]
    patterns = [(k, k % 3, None if k % 4 else k % 5, ["", "missing_content", None, "value_mismatches"][k % 4], "contains" if k % 5 else None, words[k % 10] + ("" if k % 2 else words[k % 7]), k % 11 != 0) for k in range(60)]
    results = [(r, 0 if r < 25 else r % 4, r % 6) for r in range(40)]
    told = ["The page Footer STAMP", "ÆØÅ x", "nothing", "a.b (see page)", "axb"]
    findings = [(r, bucket, pos, told[(r + pos) % 5]) for r, *_ in results for pos, bucket in enumerate(["missing_content", "value_mismatches", "value_mismatches"])]
    hits = R.pattern_hits(
        spark.createDataFrame(findings, "rr_id long, bucket string, bucket_pos int, description string"),
        spark.createDataFrame(patterns, "pattern_id long, project_id long, form_id long, category string, match_mode string, pattern string, is_active boolean"),
        spark.createDataFrame(results, "rr_id long, project_id long, form_id long"),
    )
    expected = {}
    for rr, bucket, pos, text in findings:
        _, project, form = results[rr]
        fits = [p[0] for p in patterns if p[6] and p[1] == project and p[3] in ("", None, bucket) and (p[2] is None or (form and p[2] == form)) and p[5].lower() in text.lower()]
        if fits:
            expected[rr, bucket, pos] = min(fits)
    assert {(h.rr_id, h.bucket, h.bucket_pos): h.pattern_id for h in hits.collect()} == expected and len(expected) > 20


def test_findings_without_patterns_do_not_travel(spark):
    """Findings of projects without patterns go before texts are made: the semi-join stands below the numbering of findings."""
    from formcheck.plans.review_queries import pattern_hits
    from formcheck.sources.fixtures import Tables

    plan = pattern_hits(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Window") :] and plan.count("LeftSemi") > plan.count("Window")


def test_results_are_brought_together_once(spark):
    """findings are dealt by result once for numbering, writing and reading them, and are those of the view."""
    from formcheck.plans.evidence_queries import schema_defaults
    from formcheck.plans.findings_queries import result_json_round_trip
    from formcheck.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for q in (result_json_round_trip, schema_defaults):
        assert q(t)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert t.result_findings().schema.simpleString() == t.fx_findings.schema.simpleString()
    assert t.result_findings().exceptAll(t.fx_findings).isEmpty() and t.fx_findings.exceptAll(t.result_findings()).isEmpty()


def test_lists_and_odd_values_under_buckets(spark):
    """Documents of lists are read at once, others value by value; a key told twice counts once, by its last value."""
    items = {
        '{"spelling_errors": [{"a": [1, "x"]}, null, "y", 3, [4]], "other": {"b": 1}}': {"spelling_errors": ['{"a":[1,"x"]}', None, "y", "3", "[4]"]},
        '{"spelling_errors": [1], "missing_content": {"page": 3}, "extra_content": "one", "top_findings": null}': {"spelling_errors": ["1"], "missing_content": ['{"page":3}'], "extra_content": ["one"]},
        '{"spelling_errors": [1], "spelling_errors": [2]}': {"spelling_errors": ["2"]},
        '{"spelling_errors": [1], "spelling_errors": {"page": 2}}': {"spelling_errors": ['{"page":2}']},
        '{"spelling_errors": "", "format_issues": true, "_corrupt_record": "x"}': {"spelling_errors": [""], "format_issues": ["true"]},
        '{"spelling_errors": [], "_corrupt_record": "x"}': {}, '{"spelling_errors": [1], "missing_content"': {}, " {}": {}, "[1]": {}, '"x"': {}, "": {},
    }
    rows = O.schema_defaults(spark.createDataFrame(list(enumerate(items)), "rr_id int, result_json string")).collect()
    assert len(rows) == 15 * len(items)
    for n, (text, expected) in enumerate(items.items()):
        assert {r.bucket: [x.replace(" ", "") if x else x for x in r["items"]] for r in rows if r.rr_id == n and r["items"]} == expected, text


def test_written_documents_keep_order(spark):
    rows = [(1, "b", 2, 5, None, "f", "z", True), (1, "b", 1, None, "low", None, "y", True), (1, "a", 3, 1, "low", "f", 'q"', True), (2, "a", 0, 1, None, None, None, False)]
    told = {r.rr_id: r.result_json for r in O.write_result_json(spark.createDataFrame(rows, FINDING)).collect()}
    assert told == {1: '{"a":[{"page":1,"severity":"low","field":"f","description":"q\\""}],"b":[{"severity":"low","description":"y"},{"page":5,"field":"f","description":"z"}]}', 2: '{"a":[{"page":1}]}'}


def test_suppression_is_logged_by_pattern_and_result(spark):
    """counts are added to those stored, patterns that took nothing stay, and what was taken is logged in order, cut at 120 and 80 characters."""
    long = "Total differs " + "x" * 150
    findings = [(1, "visual_mismatches", 0, long), (1, "spelling_errors", 1, "total b"), (1, "spelling_errors", 0, "TOTAL a"), (1, "observations", 0, "total"), (2, "missing_content", 0, "total c"), (2, "missing_content", 1, "other"), (3, "missing_content", 0, "total d")]
    patterns = [(1, 10, None, "", "contains", "total", True, 5), (2, 10, None, "", "regex", "^total", True, 3), (3, 10, None, "", "contains", "y" * 90, True, None), (4, 10, None, "", "contains", "other", False, 2), (5, 10, 6, "", "exact", "Other", True, None)]
    log = R.suppression_log(
        spark.createDataFrame(findings, "rr_id long, bucket string, bucket_pos int, description string"),
        spark.createDataFrame(patterns, "pattern_id long, project_id long, form_id long, category string, match_mode string, pattern string, is_active boolean, suppressed_count int"),
        spark.createDataFrame([(1, 10, 5), (2, 10, 6), (3, 11, 5)], "rr_id long, project_id long, form_id long"),
    )
    rows = {(r.pattern_id, r.rr_id): (r.suppressed, r.suppressed_count, r.form_id, r["items"] and [tuple(x) for x in r["items"]]) for r in log.collect()}
    assert rows == {
        (1, 1): (4, 9, 5, [("spelling_errors", "TOTAL a"), ("spelling_errors", "total b"), ("visual_mismatches", long[:120])]), (1, 2): (4, 9, 6, [("missing_content", "total c")]),
        (2, None): (0, 3, None, None), (3, None): (0, 0, None, None), (4, None): (0, 2, None, None), (5, 2): (1, 1, 6, [("missing_content", "other")]),
    }
    assert log.where("pattern_id = 3").first().pattern == "y" * 80


def test_hits_of_the_log_are_found_once(spark):
    """counts and items of the log come from one search of the texts."""
    from formcheck.plans.review_queries import suppression_log
    from formcheck.sources.fixtures import Tables

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = suppression_log(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("MapInArrow") == 1
