"""Exact edges of the scalar functions."""

from datetime import datetime

from pyspark.sql import functions as F

from formcheck.functions import scalars as S


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_safe_page(spark):
    rows = [("7",), (" 7 ",), ("3.0",), ("p4",), ("",), (None,)]
    assert values(spark, rows, "p string", S.safe_page(F.col("p"))) == [7, 7, None, None, None, None]


def test_is_ocr_artifact(spark):
    rows = [("premiurn", "premium"), ("Smith", "Smyth"), ("cat", "cut"), ("100.00", "90.00"), ("a b c d", "a b c e"), (None, "x"), ("", "")]
    assert values(spark, rows, "a string, b string", S.is_ocr_artifact(F.col("a"), F.col("b"))) == [True, True, False, False, False, False, False]


def test_page_ranges(spark):
    rows = [([1, 2, 3, 5, 7, 8],), ([],), ([4, None],), ([8, 7],)]
    assert values(spark, rows, "p array<int>", S.page_ranges(F.col("p"))) == ["1-3, 5, 7-8", "None", "4", "7-8"]


def test_sizes_and_dates(spark):
    rows = [(500,), (153 * 1024,), (1_200_000,), (None,), (0,)]
    assert values(spark, rows, "n long", S.fmt_size(F.col("n"))) == ["500 B", "153 KB", "1.1 MB", "—", "—"]
    rows = [(datetime(2017, 8, 9, 4, 12, 49),), (None,)]
    assert values(spark, rows, "t timestamp", S.fmt_date(F.col("t"))) == ["Aug 09, 2017 04:12 AM", "—"]
    assert values(spark, rows, "t timestamp", S.to_eastern(F.col("t"))) == ["2017-08-09 at 00:12", "—"]


def test_repair_json(spark):
    rows = [('```json\n{"a": 1}\n```',), ('Well: {"a": 1} so.',), ("no json",), ("",), (None,)]
    out = values(spark, rows, "t string", F.coalesce(F.get_json_object(S.repair_json(F.col("t")), "$.a"), F.get_json_object(S.repair_json(F.col("t")), "$.error")))
    assert out == ["1", "1"] + ["LLM returned non-JSON response"] * 3


def test_small_texts(spark):
    rows = [(" A,b ,, c",), (None,)]
    assert values(spark, rows, "t string", S.csv_tokens(F.col("t"))) == [["A", "b", "c"], []]
    rows = [("a/b c!",), ("",), ("x" * 100,)]
    assert values(spark, rows, "t string", S.safe_slug(F.col("t"))) == ["a_b_c", "test", "x" * 80]
    rows = [("<a href=\"x\">'&",)]
    assert values(spark, rows, "t string", S.escape_html(F.col("t"))) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]
    rows = [("(a)",), ("iv.",), ("12.",), ("•",), ("word",)]
    assert values(spark, rows, "t string", S.is_list_marker(F.col("t"))) == [True, True, True, True, False]
    rows = [("Arial-Bold",), ("Foo-BD",), ("X,B",), ("Arial",), (None,)]
    assert values(spark, rows, "t string", S.is_bold_font(F.col("t"))) == [True, True, True, False, False]


def test_verdict_and_mode(spark):
    rows = [("2 checks fail", None), ("fine", ""), ("", None), ("fine", "boom")]
    out = values(spark, rows, "s string, e string", S.verdict_text(F.col("s"), F.col("e")))
    assert [x.split("\n")[0] for x in out] == ["Overall Assessment: FAIL", "Overall Assessment: PASS", "Overall Assessment: Completed.", "Overall Assessment: FAIL"]
    rows = [("specific", ""), ("specific", "r"), (None, None), ("Benchmark", "")]
    assert values(spark, rows, "m string, r string", S.effective_mode(F.col("m"), F.col("r"))) == ["basic", "specific", "basic", "benchmark"]
