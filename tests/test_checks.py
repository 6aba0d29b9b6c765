from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from formcheck.operators import checks as O
from formcheck.operators.reports import evidence_files
from formcheck.plans.check_queries import find_text_bbox


def test_find_text_bbox_looks_up_every_line(spark):
    lines = [(1, 1, n, f"alpha{n} beta gamma{n} delta omega{n}" if n % 2 else f"short{n}", True, True) for n in range(10)]
    t = SimpleNamespace(spark=spark, fx_lines=spark.createDataFrame(lines, "doc_id long, page int, line_no int, line string, in_expected boolean, in_actual boolean"))
    rows = find_text_bbox(t).collect()
    assert {(r.target_id, r.found_by) for r in rows} == {(100000 + n, "sequence") for n in range(10)}


def test_find_text_bbox_first_place_and_longest_token(spark):
    """The first of repeated places; else the first word that holds the longest token, the first of equally long ones."""
    page = ["The", "form\nno", "form", "no", "form", "no", None, "unsigned", "payment"]
    words = spark.createDataFrame([(1, 1, n, w, float(n), n + 0.5, 1.0 * (n // 3), 2.0 + n // 3) for n, w in enumerate(page)], "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    targets = spark.createDataFrame([(1, 1, 1, " Form  NO "), (2, 1, 1, "no payment signed"), (3, 1, 1, "signed xyzabc"), (4, 1, 1, "pay"), (5, 1, 1, None), (6, 1, 1, ""), (7, 1, 2, "form"), (8, 1, 1, "payment " * 20)], "target_id int, doc_id long, page int, text string")
    got = {r.target_id: (r.found_by, r.x0, r.x1, r.top, r.bottom) for r in O.find_text_bbox(words, targets).collect()}
    assert got == {1: ("sequence", 2.0, 3.5, 0.0, 3.0), 2: ("word", 8.0, 8.5, 2.0, 4.0), 3: ("word", 7.0, 7.5, 2.0, 4.0), 8: ("word", 8.0, 8.5, 2.0, 4.0)}


def test_named_formats(spark):
    rows = [("MM/DD/YYYY", "02/29/1996", True), ("MM/DD/YYYY", "02/30/1996", False), ("DD/MM/YYYY", "30/01/2020", True), ("YYYY-MM-DD", "2020-1-1", False), ("email", "a@b.org", True), ("email", "a b@c.org", False),
            ("phone", "+1 (555) 010-0000", True), ("postal", "K1A 0B1", True), ("postal", "1234", False), ("currency", "$1,234.50", True), ("currency", "1.2.3", False), ("^x+$", "xx", True), ("^x+$", "xy", False), (None, "x", False), ("email", "", False)]
    table = spark.createDataFrame(rows, "wanted string, value string, ok boolean")
    assert [r.value for r in table.where(O.follows_format(F.col("value"), F.col("wanted")) != F.col("ok")).collect()] == []


def test_request_limits_by_mode(spark):
    cases = spark.createDataFrame([(1, 1, "basic", None), (2, 1, "specific", "r"), (3, 1, "benchmark", None), (4, 9, None, None)], "test_case_id int, doc_id int, mode string, rules string")
    texts = spark.createDataFrame([(1, "x" * 7000)], "doc_id int, text string")
    fields = spark.createDataFrame([(1, "b", "2"), (1, "a", "1")], "doc_id int, field_name string, field_value string")
    out = {r.test_case_id: r for r in O.request_rows(cases, texts, texts.withColumnRenamed("text", "pages"), fields).collect()}
    mark = "\n[... truncated ...]"
    assert [out[k].text for k in (1, 2, 3, 4)] == ["x" * 5000, "x" * 5000, "x" * 6000 + mark, ""]
    assert [out[k].pages for k in (1, 2, 3, 4)] == ["x" * 3000, "x" * 3000, "x" * 4000 + mark, ""]
    assert out[1].fields == '[{"field_name":"a","field_value":"1"},{"field_name":"b","field_value":"2"}]' and out[4].fields == "[]"


def test_overlapping_boxes(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 250.0, 250.0), (1, 1, 2, 240.0, 240.0, 300.0, 300.0), (1, 1, 3, 300.0, 240.0, 310.0, 300.0), (1, 2, 4, 0.0, 0.0, 9.0, 9.0), (1, 1, 5, -50.0, -50.0, 1.0, 1.0), (1, 1, 6, 5.0, 5.0, 5.0, 9.0)]
    boxes = spark.createDataFrame(rows, "doc_id int, page int, box_id int, x0 double, top double, x1 double, bottom double")
    assert sorted((r.box_id, r.other_id) for r in O.overlapping_boxes(boxes).collect()) == [(1, 2), (1, 5)]


def test_evidence_files(spark):
    rows = [(1, 7, "{}", None, "f.pdf", '["a.png"]'), (2, 8, "", None, None, "no list")]
    results = spark.createDataFrame(rows, "rr_id int, test_case_id int, result_json string, report_html_path string, form_path string, visual_diff_images string")
    assert sorted(r.path for r in evidence_files(results).collect()) == ["results/result_1_tc_7/" + x for x in ("findings.json", "tested_form.pdf", "visual_diffs/a.png")]


def test_rules_that_do_not_compile_are_left_out(spark):
    fields = spark.createDataFrame([(1, "f", "x")], "doc_id long, field_name string, field_value string")
    rules = spark.createDataFrame([(1, None, "pattern", "f", "(", None, None, None), (2, None, "pattern", "f", "^y$", None, None, None), (3, None, "pattern", "f", "email", None, None, None), (4, 2, "exact", "f", "z", None, None, None), (5, 1, "exact", "f", "z", None, None, None)],
                                  "rule_id int, doc_scope long, kind string, field_name string, arg1 string, arg2 string, cond_field string, cond_value string")
    assert sorted(r.rule_id for r in O.check_rules(fields, rules).collect()) == [2, 3, 5]


def test_context_of_odd_pairs(spark):
    """Nulls everywhere, more entries than are shown, quotes, a page without a comparison and a pair of which nothing is told."""
    from formcheck.operators import context

    rows = "pair_id long, row_no int, page int, op string, similarity double, diff_pct double, major boolean, warn boolean, is_blank boolean, has_text_changes boolean, has_formatting_changes boolean, formatting string, bold_changed array<string>, size_changed array<string>, list_shifted array<string>, graphics string, signature_label string"
    none = (None,) * 11
    told = spark.createDataFrame(
        [
            (1, 2, 2, "matched", 0.98765, 1.25, False, True, None, False, False, "kept back", [f"w{k}" for k in range(9)], ["'it's' (9pt)"], ["don't", 'say "no"', "a\\b"], "shapes 1 to 2", "SIGNATURE"),
            (1, 1, 1, None, None, None, *none), (1, 3, None, "inserted", 0.0, 100.0, *none), (2, 1, 1, "single", *(None,) * 13),
        ],
        rows,
    )
    changes = spark.createDataFrame([(1, 2, k, "deleted", f"line {k}", None) for k in range(25)] + [(1, 1, 0, "modified", "x" * 200, None)], "pair_id long, page int, change_no int, kind string, expected string, actual string")
    metadata = spark.createDataFrame([(3, "Title", None, "B")], "pair_id long, key string, expected string, actual string")
    fields = spark.createDataFrame([(3, f"f{k}", "type_changed", "text", "date") for k in range(8)] + [(3, "gone", "removed", None, None)], "pair_id long, field_name string, status string, expected_type string, actual_type string")
    out = {r.pair_id: r.context for r in context.compare_context_text(told, changes, metadata, fields).collect()}
    first, second, third = out[1].split("\n\n")
    assert first == '  Page 1: OK | similarity=1.000 (0.0% pixels differ)\nLINE DIFF (line-by-line comparison):\n    CHANGED: was="' + "x" * 80 + '"\n             now=""'
    assert second.startswith("  Page 2: WARN | similarity=0.988 (1.2% pixels differ)\nLINE DIFF") and second.count("REMOVED") == 20
    assert "BOLD CHANGED: 'w0', 'w1', 'w2', 'w3', 'w4', 'w5'\nFONT SIZE CHANGED: 'it's' (9pt)\n" in second
    assert "LIST ALIGNMENT SHIFTED: \"don't\", 'say \"no\"', 'a\\\\b'\nGRAPHICS CHANGE: shapes 1 to 2\n[SIGNATURE CANDIDATE near 'SIGNATURE']" in second and "kept back" not in second
    assert third.startswith("  Page ?: INSERTED (is_blank_page=false)")
    assert out[2] == "No visual diff data available."
    assert out[3].startswith("\nDOCUMENT-LEVEL CHANGES:\nMETADATA CHANGES (document properties):\n  Title: '' → 'B'\nFORM FIELD STRUCTURE CHANGES:\n  REMOVED FIELDS: gone\n  FIELD TYPE CHANGED: 'f0' text → date\n") and out[3].count("TYPE CHANGED") == 5
    assert context.compare_context_text(told.where("false"), changes.where("false"), metadata.where("false"), fields.where("false")).count() == 0


def test_page_images_without_alignment(spark):
    from formcheck.operators import context

    pages = spark.createDataFrame([(1, "expected", 1, "a"), (1, "actual", 1, "b"), (2, "expected", 3, "c"), (2, "actual", 5, "d"), (2, "actual", 3, None)], "pair_id long, side string, page int, image string")
    aligned = spark.createDataFrame([(1, 1, "deleted", 1, None), (1, 2, "inserted", None, 1)], "pair_id long, row_no int, op string, expected_page int, actual_page int")
    got = sorted((r.pair_id, r.row_no, r.op, r.expected_image or "", r.actual_image or "", r.label) for r in context.page_image_pairs(aligned, pages).collect())
    assert got == [
        (1, 1, "deleted", "a", "", "BASELINE page 1 — DELETED (no match in current)"), (1, 2, "inserted", "", "b", "CURRENT page 1 — INSERTED (no match in baseline)"),
        (2, 1, "page", "c", "", "page 3"), (2, 2, "page", "", "d", "page 5"),
    ]


def test_overlapping_boxes_of_any_scale(spark):
    """A box of a million points a side among small ones, against every pair; two boxes of one number are no pair."""
    random = np.random.default_rng(5)
    rows = [(1, 1, 0, -5e5, -5e5, 5e5, 5e5), (1, 1, 1, 1e6, 0.0, 2e6, 1e6), (1, 2, 0, 0.0, 0.0, 1e9, 1e9), (1, 2, 5, 0.0, 0.0, 0.0, 9.0), (1, 2, 6, None, 0.0, 1.0, 1.0)]
    for k in range(2, 120):
        x, y = random.random(2) * 900
        w, h = random.random(2) * 60
        rows.append((1, 1, k, float(x), float(y), float(x + w), float(y + h)))
    rows += [(2, 1, 1, 0.0, 0.0, 5.0, 5.0), (2, 1, 1, 1.0, 1.0, 6.0, 6.0), (2, 1, 2, 5.0, 5.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, "doc_id long, page int, box_id int, x0 double, top double, x1 double, bottom double")
    expected = set()
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] < b[2] and None not in (a[3], b[3]) and a[3] < a[5] and b[3] < b[5] and a[3] < b[5] and b[3] < a[5] and a[4] < b[6] and b[4] < a[6]:
                expected.add((a[0], a[1], a[2], b[2]))
    assert {(r.doc_id, r.page, r.box_id, r.other_id) for r in O.overlapping_boxes(boxes).collect()} == expected
    sides = [np.array(x) for x in zip(*((r[3], r[5], r[4], r[6]) for r in rows if r[:2] == (1, 1)), strict=True)]
    assert {tuple(sorted(p)) for p in zip(*(x.tolist() for x in O.swept_pairs(*sides, at_once=7)), strict=True)} == {(a, b) for _, page, a, b in expected if page == 1 and _ == 1}


def test_words_are_looked_up_where_pages_stand(spark):
    """Pages of words and targets give what single ones give, and are not dealt anew; so are documents of words."""
    from formcheck.plans.check_queries import font_outliers
    from formcheck.sources.fixtures import Tables

    page = ["The", "form", "no", "unsigned", None]
    words = spark.createDataFrame([(1, 1, n, w, float(n), n + 0.5, 0.0, 1.0) for n, w in enumerate(page)], "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    targets = spark.createDataFrame([(1, 1, 1, "form  NO"), (2, 1, 1, "signed"), (3, 1, 1, ""), (4, 1, 1, None), (5, 1, 1, "x")], "target_id int, doc_id long, page int, text string")
    listed = lambda df, c, n: df.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*c)).alias(n))
    pages = listed(words, ["word_no", "text", "x0", "x1", "top", "bottom"], "words").join(listed(targets, ["target_id", "text"], "targets"), ["doc_id", "page"])
    assert sorted(O.find_text_bbox(pages).collect()) == sorted(O.find_text_bbox(words, targets).collect())
    assert {r.target_id: (r.found_by, r.x0) for r in O.find_text_bbox(pages).collect()} == {1: ("sequence", 1.0), 2: ("word", 3.0)}
    rows = [(1, 1, n, "w", s, f) for n, (s, f) in enumerate([(10.0, "A"), (10.0, "A-Bold"), (13.0, "B"), (13.0, "A"), (7.0, "A"), (12.5, None), (5.0, "A")])] + [(2, 1, 0, "w", None, "A"), (2, 1, 1, "w", None, None), (2, 1, 2, "w", 30.0, None), (3, 2, 0, "w", 9.0, "A")]
    single = spark.createDataFrame(rows, "doc_id long, page int, word_no int, text string, size double, fontname string")
    whole = single.groupBy("doc_id").agg(F.collect_list(F.struct("page", "word_no", "text", "size", "fontname")).alias("words"))
    told = lambda df: sorted((r.doc_id, r.word_no, r.severity) for r in O.font_outliers(df).collect())
    assert told(single) == told(whole) == [(1, 2, "high"), (1, 3, "medium"), (1, 4, "medium"), (1, 5, "medium"), (1, 6, "high")]
    t = Tables(spark, "/root/testdata/sf0.001")
    for df in (find_text_bbox(t), font_outliers(t)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_context_of_pairs_that_stand_together(spark):
    """The query brings the lines of a result together once, as the views give them, and deals nothing anew by page."""
    from formcheck.operators import context
    from formcheck.plans import check_queries as C
    from formcheck.plans.registry import QUERIES
    from formcheck.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lists = t.result_lists()
    for view, name in ((t.fx_findings, "findings"), (t.fx_visual, "visual")):
        rows = lists.select("rr_id", F.inline(name))
        own = view.select(*rows.columns)
        assert rows.count() == own.count() and rows.exceptAll(own).count() == 0
    part = lambda text: spark.sql(text, **{v: getattr(t, v) for v in ("fx_visual", "fx_findings", "fx_results") if f"{{{v}}}" in text})
    empty = F.array().cast("array<string>")
    rows = part(C._CTX_ROWS).select("*", *[empty.alias(name) for name in ("bold_changed", "size_changed", "list_shifted")])
    apart = context.compare_context_text(rows, part(C._CTX_CHANGES), part(C._CTX_METADATA), part(C._CTX_FIELDS))
    together = QUERIES["compare_context_text"](spark, "/root/testdata/sf0.001")
    assert together.count() == apart.count()
    # Where a pair has none of the listed words, both ways tell the same.
    words = ("BOLD CHANGED", "FONT SIZE CHANGED", "LIST ALIGNMENT SHIFTED", "FORMATTING: ")
    plain = lambda df: {(r.pair_id, r.context) for r in df.collect() if not any(w in r.context for w in words)}
    assert plain(together) and plain(together) <= {(r.pair_id, r.context) for r in apart.collect()}
    assert QUERIES["compare_context_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
