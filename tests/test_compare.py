"""Comparison helpers: alignment, regions, lines, shapes, text changes."""

import time

import numpy as np
from pyspark.sql import functions as F

from formcheck.operators import alignment as A
from formcheck.operators import compare as O


def test_align():
    same = np.eye(3)
    assert [s[0] for s in A.align(3, 2, same[:, [0, 2]])] == ["matched", "deleted", "matched"]
    assert [s[0] for s in A.align(2, 3, same[[0, 2], :])] == ["matched", "inserted", "matched"]
    assert [s[0] for s in A.align(0, 2, np.zeros((0, 2)))] == ["inserted", "inserted"]
    assert A.align(1, 1, np.array([[0.5]])) == [("matched", 0, 0)]


def whole_matrix(n, m, similarity):
    """The cost matrix cell by cell, and the way back."""
    cost = np.zeros((n + 1, m + 1))
    cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + 2 * (1 - similarity[i - 1, j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    steps, i, j = [], n, m
    while i or j:
        if i and j and abs(cost[i, j] - cost[i - 1, j - 1] - 2 * (1 - similarity[i - 1, j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            steps.append(("matched", i, j))
        elif i and (not j or abs(cost[i, j] - cost[i - 1, j] - 1) < 1e-9):
            i -= 1
            steps.append(("deleted", i, None))
        else:
            j -= 1
            steps.append(("inserted", None, j))
    return steps[::-1]


def test_band_equals_the_whole_matrix():
    random = np.random.default_rng(4)
    for case in range(120):
        n, m = random.integers(0, 30, 2)
        # Coarse values give many ties; near-diagonal ones narrow bands.
        similarity = np.round(random.random((n, m)) * (1, 4, 2)[case % 3]) / (1, 4, 2)[case % 3]
        if case % 2 and n and m:
            similarity[np.abs(np.subtract.outer(np.arange(n), np.arange(m))) > 2] = 0
        assert A.align(int(n), int(m), similarity) == whole_matrix(n, m, similarity)


def test_long_documents_ask_for_few_similarities():
    asked = []

    def likeness(i, j):
        asked.append(len(i))
        # Page 700 of 2,000 is gone, and ten pages changed.
        return np.where(j + (j >= 700) == i, np.where(i % 200 == 7, 0.6, 1.0), 0.1)

    steps = A.align(2000, 1999, likeness)
    assert [s for s in steps if s[0] != "matched"] == [("deleted", 700, None)] and sum(asked) < 80_000


def test_thumbnails():
    assert (A.thumbnail(np.full((300, 200), 77, np.uint8)) == 77).all()
    same = np.random.default_rng(1).integers(0, 256, (210, 150)).astype(np.uint8)
    assert (A.thumbnail(same) == same).all()  # nothing to resample
    half = np.repeat(np.array([[0, 255]], np.uint8), 400, 0).repeat(300, 1)
    small = A.thumbnail(half).astype(int)
    assert small.shape == (210, 150) and (small[:, :70] == 0).all() and (small[:, 80:] == 255).all()
    # One row by the filter's definition, in exact fractions of its weights.
    row = np.random.default_rng(2).integers(0, 256, (1, 40)).astype(np.uint8)
    out, scale = A.thumbnail(row, (10, 1))[0], 4.0
    for x in range(10):
        centre = (x + 0.5) * scale
        at = np.arange(max(0, int(centre - 3 * scale + 0.5)), min(40, int(centre + 3 * scale + 0.5)))
        t = (at + 0.5 - centre) / scale
        w = np.sinc(t) * np.sinc(t / 3)
        assert abs(out[x] - np.clip((w / w.sum() * row[0, at]).sum(), 0, 255)) <= 0.51


def test_align_page_rasters(spark):
    random = np.random.default_rng(3)
    pages = [(random.integers(0, 2, (40, 30)) * 255).astype(np.uint8).repeat(5, 0).repeat(5, 1) for _ in range(6)]
    rows = [(pair, side, no, 150, 200, pages[k].tobytes()) for pair, side, numbers in ((1, "expected", [0, 1, 2, 3]), (1, "actual", [0, 2, 3]), (2, "expected", [4]), (2, "actual", [5, 4, 1]), (3, "actual", [1]), (4, "expected", [1, 2]), (4, "actual", [2, 1])) for no, k in enumerate(numbers, 1)]
    rows += [(5, "expected", 1, 1, 1, None), (5, "expected", 2, 2, 1, bytes([9, 9, 9, 200, 1, 1])), (5, "actual", 1, 1, 1, b"")]
    df = spark.createDataFrame(rows, "pair_id long, side string, page int, width int, height int, pixels binary")
    got = {}
    for r in A.align_page_rasters(df).orderBy("pair_id", "row_no").collect():
        got.setdefault(r.pair_id, []).append((r.op[0], r.expected_page, r.actual_page))
    assert got[1] == [("m", 1, 1), ("d", 2, None), ("m", 3, 2), ("m", 4, 3)]
    assert got[2] == [("i", None, 1), ("m", 1, 2), ("i", None, 3)]
    assert got[3] == [("i", None, 1)] and got[4] == [("m", 1, 1), ("m", 2, 2)]
    assert got[5] == [("m", 1, 1), ("d", 2, None)]


def test_merge_boxes():
    assert O.merge_boxes([(0, 0, 4, 4), (8, 0, 12, 4)], 4) == [(0, 0, 12, 4)]
    assert O.merge_boxes([(0, 0, 4, 4), (9, 0, 12, 4)], 4) == [(0, 0, 4, 4), (9, 0, 12, 4)]


def test_compare_rasters():
    page = np.full((32, 32), 255, np.uint8)
    other = page.copy()
    other[28:32, 0:8] = 0
    d = O.compare_rasters(page, other)
    assert d["bbox"] == [0, 28, 8, 32] and round(d["diff_pct"], 4) == 3.125 and d["zone_pcts"]["header"] == 0.0 and d["zone_pcts"]["footer"] > 1.5
    assert O.compare_rasters(page, page)["blank"] and O.compare_rasters(page, page)["bbox"] is None
    assert O.compare_rasters(page, np.zeros((40, 20), np.uint8))["diff_pct"] == 100 * (40 * 20) / (40 * 32)


def test_cluster_lines_is_anchored(spark):
    rows = [(1, 1, k, "w", 10.0 * k, 10.0 * k + 5, float(top), top + 10.0) for k, top in enumerate((0, 3, 6))]
    words = spark.createDataFrame([*rows, (1, 1, 9, "DRAFT", 0.0, 5.0, 0.0, 10.0)], "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    assert sorted((r.word_no, r.line) for r in O.cluster_lines(words).collect()) == [(0, 1), (1, 1), (2, 2)]


def test_graphics_tolerance(spark):
    schema = "pair_id long, page int, x0 double, top double, x1 double, bottom double"
    e = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 100.0, 0.0, 110.0, 10.0)], schema)
    a = spark.createDataFrame([(1, 1, 5.0, 5.0, 15.0, 15.0), (1, 1, 105.1, 0.0, 110.0, 10.0)], schema)
    assert sorted((r.change, r.x0) for r in O.graphics_diff(e, a).collect()) == [("added", 105.1), ("removed", 100.0)]


def test_sequence_changes():
    assert O.sequence_changes(["a b", "c"], ["a x", "c"]) == [("modified", "a b", "a x", ["b"], ["x"])]
    assert O.sequence_changes(["a"], ["a", "b"]) == [("inserted", "", "b", [], ["b"])]
    assert O.sequence_changes(["a", "b"], ["b"]) == [("deleted", "a", "", ["a"], [])]
    assert O.sequence_changes(["a", "b"], ["x", "y"])[0][0] == "replaced_block"
    assert O.sequence_changes(["a  b"], ["a b"]) == []
    assert O.sequence_changes(["one two three four"], ["two three 4 four"])[0][3:] == (["one"], ["4"])


def test_changed_texts_are_words_of_modified_and_whole_paragraphs(spark):
    pages = spark.createDataFrame([(1, 1, ["same", "due in ten days", "gone"], ["same", "due in 14 days"]), (2, 1, None, ["new one", " new one ", ""])], "pair_id int, page int, expected array<string>, actual array<string>")
    rows = {r.pair_id: r for r in O.changed_texts(O.paragraph_diff(pages)).collect()}
    assert (rows[2].added, rows[2].removed) == (["new one"], [])
    assert "gone" in rows[1].removed and "same" not in rows[1].removed


def test_field_change_status_of_null_types(spark):
    scan = spark.createDataFrame([(1, "a", None, 1, 1), (1, "b", "text", 1, 2)], "pair_id int, field_name string, field_type string, page int, tab_order int")
    assert {(r.field_name, r.status) for r in O.field_change_status(scan, scan).collect()} == {("a", "unchanged"), ("b", "unchanged")}
    assert {(r.field_name, r.status) for r in O.field_change_status(scan, scan.where("field_name = 'b'")).collect()} == {("a", "removed"), ("b", "unchanged")}


def test_colour_rasters():
    page = np.full((16, 16, 3), 255, np.uint8)
    other = page.copy()
    other[0:4, :, 0] = 150  # red is down by 105: luma 31
    assert O.compare_rasters(page, other)["diff_pct"] == 25.0
    other[0:4, :, 0] = 200  # by 55: luma 16
    assert O.compare_rasters(page, other)["diff_pct"] == 0.0
    assert O.compare_rasters(page[:, :, 0], page)["bbox"] is None


def test_raster_diff_takes_grey_and_colour(spark):
    schema = "page int, width int, height int, pixels binary"
    grey, colour = spark.createDataFrame([(1, 4, 2, bytearray(8))], schema), spark.createDataFrame([(1, 4, 2, bytearray(24))], schema)
    pairs = spark.createDataFrame([(1, 1, 1)], "pair_id int, expected_page int, actual_page int")
    assert [r.diff_pct for r in O.raster_diff(pairs, grey, colour).collect()] == [0.0]


def test_formatting_sentences(spark):
    schema = "pair_id int, page int, side string, para int, line int, pos int, text string, fontname string, size double, x0 double"
    rows = [(1, 1, "expected", 1, 1, k, w, "Arial", 10.0, 0.0) for k, w in enumerate(["it's", "b", "c", "d", "1."])]
    moved = [(1, 1, "actual", 1, 1, k, w, "Arial-Bold" if k == 0 else "Arial", 12.0 if k == 1 else 10.0, -20.0 if k == 3 else 20.0 if k != 4 else 6.0) for k, w in enumerate(["it's", "b", "c", "d", "1."])]
    words = spark.createDataFrame([*rows, *moved], schema)
    text = "Text became bold: \"it's\" | Font size changed: 'b' (10.0pt→12.0pt) | List marker(s) alignment shifted: '1.' | 3 body text element(s) indented right | 1 body text element(s) indented left"
    sentences = O.formatting_sentences(O.format_changes(words))
    assert [r.formatting for r in sentences.collect()] == [text]
    changes = O.paragraph_diff(spark.createDataFrame([(1, 1, ["x"], []), (2, 1, ["y"], [])], "pair_id int, page int, expected array<string>, actual array<string>"))
    out = {r.pair_id: r.summary for r in O.diff_summaries(changes, formats=sentences).collect()}
    assert out == {1: '  REMOVED: "x"\n  FORMATTING: ' + text, 2: '  REMOVED: "y"'}
    assert [r.summary for r in O.diff_summaries(changes.where("pair_id = 3"), formats=sentences).collect()] == ["FORMATTING: " + text]


def test_page_similarity_by_prefixes(spark):
    """As the whole join above the bound, with a word on every page; frequent words form no rows."""
    random = np.random.default_rng(6)
    rows = []
    for pair in range(3):
        for page in range(1, 31):
            own = [f"w{k}" for k in random.integers(0, 20_000, 40)] + [f"hot{k}" for k in range(10)]
            rows.append((pair, "expected", page, " ".join(own)))
            changed = [w if random.random() > 0.1 else f"new{random.integers(0, 900)}" for w in own]
            rows.append((pair, "actual", page, " ".join(changed)))
    rows += [(9, "expected", 1, ""), (9, "actual", 1, None), (9, "expected", 2, "one"), (9, "actual", 2, "One one")]
    pages = spark.createDataFrame(rows, "pair_id long, side string, page int, text string")
    key = lambda df: {(r.pair_id, r.expected_page, r.actual_page): round(r.similarity, 12) for r in df.collect()}
    whole = key(O.page_similarity(pages))
    for least in (0.3, 0.5, 0.6, 0.9, 1.0):
        assert key(O.page_similarity(pages, least)) == {k: v for k, v in whole.items() if v >= least}
    words = pages.selectExpr("pair_id", "side", "page", "explode(array_distinct(split(lower(text), ' '))) AS word").where("word <> ''")
    assert len(whole) > 2700 and O.similar_candidates(words, 0.6).count() < len(whole) / 10


def test_align_page_texts_equals_the_joined_similarity(spark):
    random = np.random.default_rng(7)
    rows = []
    for pair in range(12):
        texts = [" ".join(f"w{k}" for k in random.integers(0, 30, 12)) for _ in range(12)]
        for side in ("expected", "actual"):
            kept = [t for t in texts if random.random() > 0.2]
            rows += [(pair, side, 3 * k, t + (" x" if random.random() > 0.5 else "")) for k, t in enumerate(kept)]
    rows += [(90, "actual", 1, None), (91, "expected", 5, "a"), (91, "expected", 6, "b"), (91, "actual", 1, "b")]
    pages = spark.createDataFrame(rows, "pair_id long, side string, page int, text string")
    numbered = pages.selectExpr("pair_id", "side", "text", "row_number() OVER (PARTITION BY pair_id, side ORDER BY page) AS page")
    counts = pages.groupBy("pair_id").pivot("side", ["expected", "actual"]).count().fillna(0).toDF("pair_id", "n_expected", "n_actual")
    own = lambda df: sorted(map(tuple, df.select("pair_id", "row_no", "op", F.coalesce("expected_page", F.lit(0)), F.coalesce("actual_page", F.lit(0))).collect()))
    assert own(A.align_page_texts(pages)) == own(A.align_pages(counts, O.page_similarity(numbered)))


def test_line_numbers():
    random = np.random.default_rng(8)
    for _ in range(200):
        tops = np.sort(np.round(random.random(random.integers(0, 60)) * 40, random.integers(0, 3)))
        anchor, line, expected = None, 0, []
        for top in tops:
            if anchor is None or top - anchor > 4.0:
                anchor, line = top, line + 1
            expected.append(line)
        assert O.line_numbers(tops, 4.0).tolist() == expected
    assert O.line_numbers(np.array([np.nan, np.nan, 1.0, 2.0]), 4.0).tolist() == [1, 2, 3, 3]

    def taken(n):
        tops = np.arange(n) * 0.5
        at = time.perf_counter()
        O.line_numbers(tops, 4.0)
        return time.perf_counter() - at

    taken(1000)
    assert taken(100_000) < 400 * max(taken(1000), 1e-4)  # in proportion; by squares it would be 10,000 times


def test_cluster_lines_of_one_large_page(spark):
    words = spark.range(30_000).selectExpr("1L AS doc_id", "1 AS page", "CAST(id AS INT) AS word_no", "'word' AS text", "CAST(id % 10 AS DOUBLE) AS x0", "0.0D AS x1", "CAST(floor(id / 10) * 12 AS DOUBLE) AS top", "0.0D AS bottom")
    lined = O.cluster_lines(words)
    assert lined.count() == 30_000 and lined.agg(F.max("line"), F.max("pos")).first()[:] == (3000, 10)


def test_format_changes_with_odd_words(spark):
    one = (7, 1, 1, 1)
    rows = [
        (*one, 1, "expected", "a", "Arial", 10.0, 0.0), (*one, 1, "actual", "a", "Arial-Bold", 10.0, 0.0),
        (*one, 2, "expected", "b", None, 10.0, None), (*one, 2, "actual", "b", "Arial", 14.0, 9.0),
        (*one, 3, "expected", " ", "Arial", 10.0, 0.0), (*one, 3, "actual", "c", "Arial", 20.0, 90.0),
        (*one, 4, "actual", "d", "Arial", 20.0, 90.0), (*one, 5, "expected", "(a)", "Arial", 9.0, 0.0), (*one, 5, "actual", "(a)", "Arial", 9.0, 6.0),
        (7, None, 1, 1, 1, "expected", "x", "Arial", 9.0, 0.0), (7, None, 1, 1, 1, "actual", "x", "Arial", 19.0, 0.0), (*one, 6, "other", "x", "Arial", 19.0, 0.0),
    ]
    words = spark.createDataFrame(rows, "pair_id long, page int, para int, line int, pos int, side string, text string, fontname string, size double, x0 double")
    got = {(r.pos, r.change): (r.e_size, r.a_size, r.x_shift) for r in O.format_changes(words).where("page IS NOT NULL").collect()}
    assert got == {(1, "bold_added"): (10.0, 10.0, 0.0), (2, "larger"): (10.0, 14.0, None), (5, "list_shift"): (9.0, 9.0, 6.0)}
    assert O.format_changes(words.where("false")).count() == 0


def test_page_texts_of_a_document_travel_once(spark):
    """The words of pages form no rows that are shuffled: texts are dealt by pair, and pages are cut where documents stand."""
    from formcheck.plans.compare_queries import page_texts
    from formcheck.sources.fixtures import Tables

    texts = page_texts(Tables(spark, "/root/testdata/sf0.001"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(texts)
    assert plan(O.page_similarity(texts, 0.6)).count("Exchange hashpartitioning") == 1


def test_page_similarity_of_large_pairs_goes_by_joins(spark, monkeypatch):
    from formcheck.plans.compare_queries import page_texts
    from formcheck.sources.fixtures import Tables

    pages = page_texts(Tables(spark, "/root/testdata/sf0.001")).where("pair_id < 60")
    rows = lambda least: sorted((*r[:3], round(r[3], 12)) for r in O.page_similarity(pages, least).collect())
    near = rows(0.0), rows(0.6)
    monkeypatch.setattr(O, "TOGETHER", 4)
    assert (rows(0.0), rows(0.6)) == near and len(near[0]) > len(near[1]) > 0


def test_repeated_documents_are_paged_as_their_lines(spark, tmp_path):
    from formcheck.sources.fixtures import Tables

    spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf"), (2, "x"), (1, "a\ng"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [(p.page, [(x.line_no, x.line) for x in p.lines]) for p in r.pages] for r in Tables(spark, str(tmp_path)).paged_documents().collect()}
    assert got == {1: [(1, [(0, "a"), (0, "a"), (1, "b"), (1, "g"), (2, "c"), (3, "d"), (4, "e")]), (2, [(5, "f")])], 2: [(1, [(0, "x")])]}


def test_alignment_takes_many_pairs_in_a_task_at_once(spark):
    """No group of frames for each pair: pairs are rows of batches."""
    pages = spark.createDataFrame([(1, "expected", 1, "a b"), (1, "expected", 2, "c"), (1, "actual", 1, "c"), (2, "actual", 4, "x"), (2, "expected", 4, "y")], "pair_id long, side string, page int, text string")
    counts = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 0, 0), (4, 0, 1)], "pair_id long, n_expected int, n_actual int")
    own = lambda df: sorted(map(tuple, df.select("pair_id", "row_no", "op", F.coalesce("expected_page", F.lit(0)), F.coalesce("actual_page", F.lit(0))).collect()))
    similar = O.page_similarity(pages)
    for df, more in ((A.align_page_texts(pages), []), (A.align_pages(counts, similar), [(4, 1, "inserted", 0, 1)])):
        assert "CoGroup" not in df._jdf.queryExecution().executedPlan().toString()
        assert own(df) == [(1, 1, "deleted", 1, 0), (1, 2, "matched", 2, 1), (2, 1, "matched", 1, 1), *more]


def test_overlap_of_a_large_pair_equals_the_table(monkeypatch):
    random = np.random.default_rng(8)
    sides = [[np.unique(random.integers(0, 40, size)) for size in random.integers(0, 30, 9)] for _ in range(2)]
    i, j = (x.ravel() for x in np.indices((9, 9)))
    table = A._overlap(sides)(i, j)
    monkeypatch.setattr(A, "CELLS", 0)
    assert np.array_equal(A._overlap(sides)(i, j), table)


def test_thumbnails_leave_in_small_batches():
    """A batch of pages is turned into thumbnails some at a time, so what a worker holds does not follow the batch."""
    import pyarrow as pa

    class Pages:
        schema = {c: type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "int")})}) for c in ("pair_id", "side", "page")}

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            n = 200
            columns = [pa.array([1] * n), pa.array(["actual"] * n), pa.array(range(n)), pa.array([1] * n), pa.array([1] * n), pa.array([b"\0"] * n)]
            return list(run(iter([pa.RecordBatch.from_arrays(columns, ["pair_id", "side", "page", "width", "height", "pixels"])])))

    sizes = [b.num_rows for b in A.thumbnails(Pages())]
    assert sum(sizes) == 200 and max(sizes) <= A.AT_ONCE


def test_formats_of_pages_are_compared_where_they_stand(spark):
    """No shuffle of words, and the ordered words of a page are made once."""
    from formcheck.plans import compare_queries as Q
    from formcheck.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for df in (Q.formatting_sentences(t), Q.format_diff(t)):
        execution = df._jdf.queryExecution()
        assert "Exchange" not in execution.executedPlan().toString()
        assert execution.optimizedPlan().toString().count("sort_array(") == 1


def test_lines_and_paragraphs_of_pages_where_they_stand(spark):
    """Single words, with a missing top, a missing left side and a number that comes twice, give what pages of them give; nothing of
    pages is dealt anew."""
    from formcheck.plans.compare_queries import cluster_lines, cluster_paragraphs
    from formcheck.sources.fixtures import Tables

    rows = [(1, 1, n, t, x, 9.0, y, b) for n, t, x, y, b in [(0, "b", 5.0, 0.0, 10.0), (1, "a", 1.0, 3.0, 13.0), (2, "c", None, 6.0, 16.0), (2, "d", 2.0, 6.0, 16.0), (3, "e", 0.0, 40.0, 50.0), (4, "f", 0.0, None, None), (5, "DRAFT", 0.0, 0.0, 9.0), (6, " ", 0.0, 0.0, 9.0)]]
    rows += [(2, 1, 0, "void", 0.0, 9.0, 0.0, 10.0), (3, 1, 0, "", 0.0, 9.0, 0.0, 10.0)]
    words = spark.createDataFrame(rows, "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    pages = words.groupBy("doc_id", "page").agg(F.collect_list(F.struct("word_no", "text", "x0", "x1", "top", "bottom")).alias("words"))
    lined = lambda df: sorted((r.doc_id, r.word_no, r.text, r.line, r.pos) for r in O.cluster_lines(df).collect())
    told = lambda df: sorted((r.doc_id, r.para, r.text, r.words, r.first_line, r.last_line) for r in df.collect())
    assert lined(words) == lined(pages)
    assert [r[1:] for r in lined(words) if r[0] == 1] == [(0, "b", 2, 2), (1, "a", 2, 1), (2, "c", 3, 1), (2, "d", 3, 2), (3, "e", 4, 1), (4, "f", 1, 1)]
    assert told(O.cluster_paragraphs(O.cluster_lines(words))) == told(O.cluster_paragraphs(O.lined_pages(pages)))
    assert [r[1:] for r in told(O.cluster_paragraphs(O.lined_pages(pages))) if r[0] == 1] == [(1, "f", 1, 1, 1), (2, "a b c d", 4, 2, 3), (3, "e", 1, 4, 4)]
    t = Tables(spark, "/root/testdata/sf0.001")
    for rows in (cluster_lines(t), cluster_paragraphs(t)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_graphics_diff_looks_where_places_stand(spark):
    """As all pairs tell: shapes on the borders of blocks, repeated ones, missing values; dealt by place and by block only, without a join."""
    import random

    r = random.Random(4)
    at = lambda: r.choice([99.9, 100.0, 100.1, 94.9, 95.0, 105.0, 105.1, -0.1, 0.0, 4.9, -5.0, 200.0, float(r.randrange(300))])
    rows = [(r.randrange(2), r.randrange(3), at(), at(), at() if r.random() < 0.3 else 100.0, r.choice([100.0, 105.0, 105.1])) for _ in range(500)]
    rows += [(1, 1, None, 5.0, 6.0, 7.0), (None, 1, 1.0, 2.0, 3.0, 4.0)]
    e, a = rows[:300] + rows[:40] + rows[-2:], rows[260:]
    schema = "pair_id long, page int, x0 double, top double, x1 double, bottom double"
    near = lambda x, y: None not in x + y and x[:2] == y[:2] and all(round(abs(p - q), 6) <= 5 for p, q in zip(x[2:], y[2:], strict=True))
    want = [("removed", *x) for x in e if not any(near(x, y) for y in a)] + [("added", *y) for y in a if not any(near(x, y) for x in e)]
    out = O.graphics_diff(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema))
    plan = out._jdf.queryExecution().executedPlan().toString()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((x.change, x.pair_id, x.page, x.x0, x.top, x.x1, x.bottom) for x in out.collect()), key=key) == sorted(want, key=key)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
