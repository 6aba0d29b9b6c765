"""Document comparison: rasters, page alignment, lines and paragraphs, text and format differences, shapes.

Keys first, payloads last: pages are paired by key before pixels or words are read, and each task works on
one page or one document pair. A page's pixels or words are bounded by the page.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formcheck import constants as K
from formcheck.functions import scalars as S

THRESHOLD = 25
GRID_COLUMNS, GRID_ROWS, CELL_PCT, REGIONS = 8, 14, 8.0, 8
RASTER = "struct<diff_pct:double,similarity:double,bbox:array<int>,bbox_area_pct:double,zone_pcts:map<string,double>,regions:array<array<int>>,blank:boolean>"
#: Pairs of pages of one document pair that are compared in one task.
TOGETHER = 1 << 18
PLACE = ["pair_id", "page", "para", "line", "pos"]
RASTER_COLUMNS = ["diff_pct", "similarity", "bbox", "bbox_area_pct", "zone_pcts", "regions", "blank"]


def merge_boxes(boxes: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Join boxes that lie within `gap` of each other until none do; a box takes in the later ones in order."""
    while True:
        out: list[list[int]] = []
        left = [list(b) for b in boxes]
        while left:
            own, rest = left[0], []
            for b in left[1:]:
                apart = own[2] + gap < b[0] or b[2] + gap < own[0] or own[3] + gap < b[1] or b[3] + gap < own[1]
                if apart:
                    rest.append(b)
                else:
                    own = [min(own[0], b[0]), min(own[1], b[1]), max(own[2], b[2]), max(own[3], b[3])]
            out.append(own)
            left = rest
        if len(out) == len(boxes):
            return [tuple(b) for b in out]
        boxes = [tuple(b) for b in out]


def luma(pixels: np.ndarray) -> np.ndarray:
    """Grey values of colour pixels; grey ones as they are."""
    return pixels if pixels.ndim == 2 else (pixels @ np.array(K.LUMA) + 0x8000) >> 16


def compare_rasters(expected: np.ndarray, actual: np.ndarray) -> dict:
    """Two pages, grey (rows x columns) or colour (rows x columns x 3), padded with white to the larger: share of
    changed pixels, box, zones, regions; and whether the actual page is blank. A pixel changed where the luma of its
    absolute difference is over the threshold; a grey page beside a coloured one has three equal channels."""
    h, w = max(expected.shape[0], actual.shape[0]), max(expected.shape[1], actual.shape[1])
    colour = expected.ndim == 3 or actual.ndim == 3
    deep = [np.repeat(p[:, :, None], 3, 2) if colour and p.ndim == 2 else p for p in (expected, actual)]
    padded = [np.pad(p, ((0, h - p.shape[0]), (0, w - p.shape[1]), *([(0, 0)] if colour else [])), constant_values=255).astype(np.int32) for p in deep]
    mask = luma(np.abs(padded[0] - padded[1])) > THRESHOLD
    actual = luma(actual.astype(np.int32))
    pct = float(mask.sum()) / max(mask.size, 1) * 100
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    box = [int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1] if len(xs) else None
    zones = {}
    for name, a, b in K.ZONES:
        part = mask[int(h * a) : h if b == 1.0 else int(h * b)]
        zones[name] = round(float(part.mean()) * 100, 2) if part.size else 0.0
    cw, ch = max(1, w // GRID_COLUMNS), max(1, h // GRID_ROWS)
    cells = [(x, y, min(x + cw, w), min(y + ch, h)) for y in range(0, ch * GRID_ROWS, ch) for x in range(0, cw * GRID_COLUMNS, cw) if x < w and y < h]
    hot = [c for c in cells if mask[c[1] : c[3], c[0] : c[2]].mean() * 100 >= CELL_PCT]
    regions = sorted(merge_boxes(hot, cw), key=lambda b: -(b[2] - b[0]) * (b[3] - b[1]))[:REGIONS] if hot else []
    area = (box[2] - box[0]) * (box[3] - box[1]) / max(1, w * h) * 100 if box else 0.0
    return {"diff_pct": pct, "similarity": min(1.0, max(0.0, (100 - pct) / 100)), "bbox": box, "bbox_area_pct": area, "zone_pcts": zones, "regions": [list(map(int, r)) for r in regions], "blank": bool((actual >= 250).mean() >= 0.98) if actual.size else True}


def raster_diff(pairs: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """pairs(pair_id, expected_page, actual_page) with rasters(page, width, height, pixels binary; one byte a pixel or
    three): one row of differences per pair. Pixels are joined last and travel once for each side."""
    side = lambda df, p: df.select(F.col("page").alias(f"{p}_page"), F.col("width").alias(f"{p}_w"), F.col("height").alias(f"{p}_h"), F.col("pixels").alias(f"{p}_pixels"))
    rows = pairs.join(side(expected, "expected"), "expected_page").join(side(actual, "actual"), "actual_page")

    @F.pandas_udf(RASTER)
    def compare(ep: pd.Series, ew: pd.Series, eh: pd.Series, ap: pd.Series, aw: pd.Series, ah: pd.Series) -> pd.DataFrame:
        out = []
        for p, w, h, q, x, y in zip(ep, ew, eh, ap, aw, ah, strict=True):
            out.append(compare_rasters(*(np.frombuffer(b, np.uint8).reshape((r, c, 3) if len(b) == 3 * r * c > 0 else (r, c)) for b, r, c in ((p, h, w), (q, y, x)))))
        return pd.DataFrame(out, columns=RASTER_COLUMNS)

    return rows.select("pair_id", "expected_page", "actual_page", compare("expected_pixels", "expected_w", "expected_h", "actual_pixels", "actual_w", "actual_h").alias("d")).select("pair_id", "expected_page", "actual_page", "d.*")


def changed_zones(zone_pcts: Column) -> Column:
    """Names of the zones that changed, from the top down."""
    return F.filter(F.array(*[F.when(zone_pcts[n] > K.ZONE_SIGNIFICANT, n) for n, _, _ in K.ZONES]), lambda x: x.isNotNull())


def change_pattern(zones: Column) -> Column:
    only = lambda names: F.size(F.array_except(zones, F.array(*map(F.lit, names)))) == 0
    return (
        F.when(F.size(zones) == 0, "no_change")
        .when(F.size(zones) >= 4, "page_wide")
        .when((F.size(zones) == 1) & only(["header"]), "header_only")
        .when(only(["header", "upper_body"]), "header_and_fields")
        .when(only(["upper_body", "middle_body", "lower_body"]), "body_content")
        .when(F.array_contains(zones, "lower_body") | F.array_contains(zones, "footer"), "footer_area")
        .otherwise("partial")
    )


def diff_flags(rows: DataFrame) -> DataFrame:
    """major and warn of rows with diff_pct, pattern and other_changes (text, format or graphics)."""
    pct, noise = F.col("diff_pct"), (F.col("pattern") == "page_wide") & ~F.coalesce("other_changes", F.lit(False))
    major, warn = pct >= K.MAJOR_PCT, pct >= K.WARN_PCT
    clear_both, clear_major = noise & (pct < K.PAGE_WIDE_CLEAR_BOTH), noise & (pct < K.PAGE_WIDE_CLEAR_MAJOR)
    return rows.withColumn("major", major & ~clear_major).withColumn("warn", warn & ~clear_both & (~major | clear_major))


def page_words(text: Column | str = "text") -> Column:
    """The different words of a page's text, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def page_similarity(pages: DataFrame, least: float = 0.0) -> DataFrame:
    """pages(pair_id, side expected|actual, page, text): token overlap (Jaccard) of the pages of a pair, from `least` on; at 0
    of all that share a word.

    A pair's texts are brought together once and its pages compared where they are; words form no rows. Pairs with more
    than TOGETHER pairs of pages, if there are any, are too much for a task and go by joins (far_similarity)."""
    sided = lambda s: F.count_if(F.col("side") == s)
    pages = pages.where("pair_id IS NOT NULL AND page IS NOT NULL")
    far = pages.groupBy("pair_id").agg((sided("expected") * sided("actual")).alias("met")).where(F.col("met") > TOGETHER).select("pair_id")
    if not far.limit(1).count():
        return near_similarity(pages, least)
    return near_similarity(pages.join(far, "pair_id", "left_anti"), least).unionByName(far_similarity(pages.join(far, "pair_id", "left_semi"), least))


def near_similarity(pages: DataFrame, least: float) -> DataFrame:
    """page_similarity() of pairs whose pages fit one task: a pair's texts in one row."""
    listed = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("page", "text")))
    pairs = pages.groupBy("pair_id").agg(listed("expected").alias("e"), listed("actual").alias("a"))
    words = lambda c: F.transform(c, lambda p: F.struct(p["page"].alias("page"), page_words(p["text"]).alias("words"))).alias(c)
    size = lambda p: F.size(p["words"])
    near = lambda x, y: F.least(size(x), size(y)) >= F.greatest(size(x), size(y)) * F.lit(least) - 1e-9
    met = lambda x, y: F.struct(x["page"].alias("expected_page"), y["page"].alias("actual_page"), F.size(F.array_intersect(x["words"], y["words"])).alias("same"), (size(x) + size(y)).alias("n"))
    others = lambda x: F.filter("a", lambda y: near(x, y)) if least > 0 else F.col("a")
    rows = F.flatten(F.transform("e", lambda x: F.transform(others(x), lambda y: met(x, y))))
    likeness = lambda m: m["same"] / (m["n"] - m["same"])
    told = F.transform(F.filter(rows, lambda m: m["same"] > 0), lambda m: F.struct(m["expected_page"].alias("expected_page"), m["actual_page"].alias("actual_page"), likeness(m).alias("similarity")))
    return pairs.select("pair_id", words("e"), words("a")).select("pair_id", F.inline(F.filter(told, lambda m: m["similarity"] >= least)))


def far_similarity(pages: DataFrame, least: float) -> DataFrame:
    """page_similarity() by joins, for pairs of any number of pages.

    Above 0 the join is on prefixes: a page's words stand with the rarest of the pair first, and two pages that are similar
    enough share one of so many first words that the rest could not make up for it. Words of most pages come last, so
    they form no rows; what meets is then compared whole. Pages of fewer than `least` times the other's words never meet."""
    told = pages.select("pair_id", "side", "page", page_words().alias("words"))
    words = told.select("pair_id", "side", "page", F.explode("words").alias("word"))
    if least <= 0:
        sizes = words.groupBy("pair_id", "side", "page").agg(F.count(F.lit(1)).alias("n"))
        side = lambda s, p: words.where(F.col("side") == s).select("pair_id", "word", F.col("page").alias(p))
        size = lambda s, p, n: sizes.where(F.col("side") == s).select("pair_id", F.col("page").alias(p), F.col("n").alias(n))
        both = side("expected", "expected_page").join(side("actual", "actual_page"), ["pair_id", "word"]).groupBy("pair_id", "expected_page", "actual_page").agg(F.count(F.lit(1)).alias("same"))
        rows = both.join(size("expected", "expected_page", "en"), ["pair_id", "expected_page"]).join(size("actual", "actual_page", "an"), ["pair_id", "actual_page"])
        return rows.select("pair_id", "expected_page", "actual_page", (F.col("same") / (F.col("en") + F.col("an") - F.col("same"))).alias("similarity"))
    met = similar_candidates(words, least)
    side = lambda s, p, w: told.where(F.col("side") == s).select("pair_id", F.col("page").alias(p), F.col("words").alias(w))
    whole = met.join(side("expected", "expected_page", "ew"), ["pair_id", "expected_page"]).join(side("actual", "actual_page", "aw"), ["pair_id", "actual_page"])
    same = F.size(F.array_intersect("ew", "aw"))
    rows = whole.select("pair_id", "expected_page", "actual_page", (same / (F.size("ew") + F.size("aw") - same)).alias("similarity"))
    return rows.where(F.col("similarity") >= least)


def similar_candidates(words: DataFrame, least: float) -> DataFrame:
    """words(pair_id, side, page, word), each once: (pair_id, expected_page, actual_page) of the pages that share a word of their
    prefixes and may be similar by their sizes."""
    common = words.groupBy("pair_id", "word").agg(F.count(F.lit(1)).alias("pages"))
    ordered = words.join(common, ["pair_id", "word"]).groupBy("pair_id", "side", "page").agg(F.array_sort(F.collect_list(F.struct("pages", "word"))).alias("words"))
    n = F.size("words")
    # Rounding must not shorten a prefix.
    first = n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1
    heads = ordered.select("pair_id", "side", "page", n.alias("n"), F.explode(F.slice("words", 1, first)).alias("w")).select("pair_id", "side", "page", "n", "w.word")
    side = lambda s, p, n: heads.where(F.col("side") == s).select("pair_id", "word", F.col("page").alias(p), F.col("n").alias(n))
    both = side("expected", "expected_page", "en").join(side("actual", "actual_page", "an"), ["pair_id", "word"])
    return both.where(F.least("en", "an") >= F.greatest("en", "an") * least - 1e-9).select("pair_id", "expected_page", "actual_page").distinct()


def alignment_rows(aligned: DataFrame, blank: DataFrame | None = None) -> DataFrame:
    """Rows of deleted and inserted pages: no similarity, all changed; an inserted blank page only warns.
    blank(pair_id, actual_page, is_blank)."""
    rows = aligned.where("op <> 'matched'")
    rows = rows.join(blank, ["pair_id", "actual_page"], "left") if blank is not None else rows.withColumn("is_blank", F.lit(False))
    soft = (F.col("op") == "inserted") & F.coalesce("is_blank", F.lit(False))
    return rows.select("pair_id", "row_no", "op", "expected_page", "actual_page", F.lit(0.0).alias("similarity"), F.lit(100.0).alias("diff_pixels_pct"), (~soft).alias("major"), soft.alias("warn"))


def direct_comparison_rows(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Deleted expected pages beside the actual page of the same number, if there is one, numbered after the
    aligned rows."""
    last = aligned.groupBy("pair_id").agg(F.max("row_no").alias("last"))
    rows = aligned.where("op = 'deleted'").join(counts.select("pair_id", "n_actual"), "pair_id").where("expected_page <= n_actual").join(last, "pair_id")
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy("expected_page"))
    return rows.select("pair_id", (F.col("last") + nth).alias("row_no"), F.lit("direct").alias("op"), "expected_page", F.col("expected_page").alias("actual_page"))


def line_numbers(tops: np.ndarray, tolerance: float) -> np.ndarray:
    """Line of each word, from 1; tops in order. Each line is one search for the first word too far below its anchor; a
    missing top (first in order) is a line of its own."""
    missing = int(np.isnan(tops).sum())
    starts, at = list(range(missing)), missing
    while at < len(tops):
        starts.append(at)
        end = int(np.searchsorted(tops, tops[at] + tolerance, "right"))
        # The sum may round to either side of the difference that counts.
        while end < len(tops) and tops[end] - tops[at] <= tolerance:
            end += 1
        while end > at + 1 and tops[end - 1] - tops[at] > tolerance:
            end -= 1
        at = end
    lines = np.zeros(len(tops), np.int32)
    lines[starts] = 1
    return np.cumsum(lines, dtype=np.int32)


def lined_pages(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(doc_id, page, words): the words of a page as structs with `line` and `pos`, in that order. words(doc_id, page, word_no, text, x0,
    x1, top, bottom, ...), or pages of them (doc_id, page, words array of structs): these are lined where they stand, while
    single words are dealt by page once. Memory is that of a page."""
    own = words.schema["words"].dataType.elementType.names if "words" in words.columns else [c for c in words.columns if c not in ("doc_id", "page")]
    if "words" not in words.columns:
        stamp = S.is_watermark(F.col("text"))
        words = words.where(~stamp).groupBy("doc_id", "page").agg(F.collect_list(F.struct(*own)).alias("words"))
    rest = [c for c in own if c not in ("x0", "top", "word_no")]
    item = lambda w: F.struct(w["top"].cast("double").alias("top"), w["word_no"].cast("int").alias("word_no"), w["x0"].alias("x0"), *[w[c].alias(c) for c in rest])
    # Missing tops stand first.
    kept = F.sort_array(F.transform(F.filter("words", lambda w: ~S.is_watermark(w["text"])), item))
    pages = words.select("doc_id", "page", F.explode(F.filter(F.array(kept), lambda a: F.size(a) > 0)).alias("items"))

    @F.pandas_udf("struct<line:array<int>,first:array<int>>")
    def numbered(tops: pd.Series) -> pd.DataFrame:
        lines = [line_numbers(np.array(x, np.float64), tolerance) for x in tops]
        return pd.DataFrame({"line": lines, "first": [np.searchsorted(x, x, "left").astype(np.int32) for x in lines]})

    lines = pages.select("doc_id", "page", "items", numbered(F.transform("items", lambda w: w["top"])).alias("n"))
    place = lambda w, k: F.struct(F.col("n.line")[k].alias("line"), *[w[c].alias(c) for c in ("x0", "top", "word_no")], F.col("n.first")[k].alias("first"), *[w[c].alias(c) for c in rest])
    told = lambda p, k: F.struct(*[p[c].alias(c) for c in own], p["line"].alias("line"), (k - p["first"] + 1).alias("pos"))
    return lines.select("doc_id", "page", F.transform(F.sort_array(F.transform("items", place)), told).alias("words"))


def cluster_lines(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """words(doc_id, page, word_no, text, x0, x1, top, bottom, ...), or pages of them: line number of each word, and its place in it.
    A line begins at a word more than the tolerance below the line's first word; stamps and blanks are left out. One search a line in
    the page's ordered array, as the anchor is not the word before."""
    return lined_pages(words, tolerance).select("doc_id", "page", F.inline("words"))


def _cut(rows: DataFrame, items: str, begins, out: str) -> DataFrame:
    """Column `items` of rows, an array, in its runs; begins(item, the one before) tells where one begins, as it does at the first."""
    at = F.array_compact(F.transform(items, lambda x, k: F.when((k == 0) | F.coalesce(begins(x, F.get(items, k - 1)), F.lit(True)), k)))
    run = lambda k, n: F.slice(items, k + 1, F.coalesce(F.get("at", n + 1), F.size(items)) - k)
    # The places are a column of their own, else they would be sought again for each run.
    return rows.withColumn("at", at).select("doc_id", "page", F.transform("at", run).alias(out))


def cluster_paragraphs(lines: DataFrame, gap: float = 0.7) -> DataFrame:
    """Lined words, or pages of them as lined_pages() has them -> one row per paragraph: text, words, first and last line. A gap of more
    than 0.7 of the line's tallest word begins a new one. Memory is that of a page."""
    if "words" not in lines.columns:
        own = F.struct("line", "pos", "text", "top", "bottom")
        lines = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(own)).alias("words"))
    of = lambda run, c: F.transform(run, lambda w: w[c])
    text = lambda run: F.array_join(of(run, "text"), " ").alias("text")
    line = lambda r: F.struct(F.array_max(of(r, "bottom")).alias("low"), F.array_min(of(r, "top")).alias("high"), F.array_max(F.transform(r, lambda w: w["bottom"] - w["top"])).alias("tall"), text(r), F.size(r).cast("long").alias("words"), r[0]["line"].alias("line"))
    runs = _cut(lines.select("doc_id", "page", "words"), "words", lambda w, before: w["line"] != before["line"], "runs")
    per = runs.select("doc_id", "page", F.transform("runs", line).alias("lines"))
    paras = _cut(per, "lines", lambda x, before: x["high"] - before["low"] > x["tall"] * gap, "paras")
    told = lambda p, k: F.struct((k + 1).cast("long").alias("para"), text(p), F.aggregate(of(p, "words"), F.lit(0).cast("long"), lambda a, n: a + n).alias("words"), p[0]["line"].alias("first_line"), F.element_at(p, -1)["line"].alias("last_line"))
    return paras.select("doc_id", "page", F.inline(F.transform("paras", told)))


def sequence_changes(expected: list[str], actual: list[str]) -> list[tuple[str, str, str, list[str], list[str]]]:
    """Differences of two paragraph lists: kind (deleted, inserted, modified: one for one, or replaced_block), both
    texts, and the removed and added texts: whole paragraphs, or the differing words of a modified one."""
    out = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, expected, actual, autojunk=False).get_opcodes():
        old, new = "\n".join(expected[a:b]), "\n".join(actual[c:d])
        if tag == "delete":
            out.append(("deleted", old, "", expected[a:b], []))
        elif tag == "insert":
            out.append(("inserted", "", new, [], actual[c:d]))
        elif tag == "replace" and b - a == d - c == 1:
            before, after = old.split(), new.split()
            parts = [x for x in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes() if x[0] != "equal"]
            if parts:
                out.append(("modified", old, new, [w for _, i, j, _, _ in parts for w in before[i:j]], [w for _, _, _, i, j in parts for w in after[i:j]]))
        elif tag == "replace":
            out.append(("replaced_block", old[:200], new[:200], expected[a:b], actual[c:d]))
    return out


def paragraph_diff(pages: DataFrame) -> DataFrame:
    """pages(pair_id, page, expected array<string>, actual array<string>): one row per change. Pages whose two
    sides are equal never reach Python."""
    changed = pages.where(~F.col("expected").eqNullSafe(F.col("actual")))

    @F.pandas_udf("array<struct<kind:string,expected:string,actual:string,removed:array<string>,added:array<string>>>")
    def diff(expected: pd.Series, actual: pd.Series) -> pd.Series:
        keys = ("kind", "expected", "actual", "removed", "added")
        sides = zip(expected, actual, strict=True)
        return pd.Series([[dict(zip(keys, x, strict=True)) for x in sequence_changes(*([] if side is None else list(side) for side in pair))] for pair in sides])

    rows = changed.select("pair_id", "page", F.posexplode(diff("expected", "actual")).alias("change_no", "c"))
    return rows.select("pair_id", "page", "change_no", "c.*")


def page_changes(words: DataFrame, size_tolerance: float = 1.2, body_shift: float = 15.0, list_shift: float = 5.0, each: bool = False) -> DataFrame:
    """(pair_id, page, changes): for each page its bold, size or shift changes of words at the same place, in order. words(pair_id, page,
    side, para, line, pos, text, fontname, size, x0) of corresponding paragraphs, or pages of them (pair_id, page, words): these
    are compared where they stand, while single words are dealt by page first. `each`: a row for each change. Memory is that of a page."""
    place = ["para", "line", "pos"]
    if "words" not in words.columns:
        own = F.struct(*place, "side", "text", "fontname", "size", "x0")
        words = words.repartition("pair_id", "page").groupBy("pair_id", "page").agg(F.collect_list(own).alias("words"))
    held = F.filter("words", lambda w: (F.trim(w["text"]) != "") & w["side"].isin("expected", "actual"))
    # The two words of a place come next to each other.
    told = lambda w: F.struct(*[w[c].alias(c) for c in place], (w["side"] == "actual").alias("now"), F.trim(w["text"]).alias("text"), S.is_bold_font(w["fontname"]).alias("bold"), w["size"].alias("size"), w["x0"].alias("x0"))
    pages = words.select("pair_id", "page", F.sort_array(F.transform(held, told)).alias("w"))
    met = F.filter(F.transform("w", lambda a, k: F.struct(a.alias("a"), F.get("w", k - 1).alias("e"))), lambda m: m["a"]["now"] & ~m["e"]["now"] & (m["e"]["para"] == m["a"]["para"]) & (m["e"]["line"] == m["a"]["line"]) & (m["e"]["pos"] == m["a"]["pos"]))

    def changes(m: Column) -> Column:
        a, e = m["a"], m["e"]
        marker, shift, grown = S.is_list_marker(a["text"]), a["x0"] - e["x0"], a["size"] - e["size"]
        kinds = F.array_compact(F.array(
            F.when(a["bold"] & ~e["bold"], "bold_added").when(e["bold"] & ~a["bold"], "bold_removed"),
            F.when((e["size"] > 0) & (a["size"] > 0) & (F.abs(grown) > size_tolerance), F.when(grown > 0, "larger").otherwise("smaller")),
            F.when((F.abs(shift) > list_shift) & marker, "list_shift").when((F.abs(shift) > body_shift) & ~marker, "body_shift"),
        ))
        row = lambda kind: F.struct(*[a[c].alias(c) for c in place], a["text"].alias("text"), F.round(shift, 1).alias("x_shift"), e["size"].alias("e_size"), a["size"].alias("a_size"), kind.alias("change"))
        return F.transform(kinds, row)

    told = F.flatten(F.transform(met, changes))
    return pages.select("pair_id", "page", F.inline(told) if each else told.alias("changes"))


def format_changes(words: DataFrame, size_tolerance: float = 1.2, body_shift: float = 15.0, list_shift: float = 5.0) -> DataFrame:
    """The changes of page_changes(), each a row."""
    return page_changes(words, size_tolerance, body_shift, list_shift, each=True)


def format_diff(words: DataFrame, size_tolerance: float = 1.2, body_shift: float = 15.0, list_shift: float = 5.0, least_body: int = 3, most: int = 30) -> DataFrame:
    """The first 30 format changes of each kind on a page; shifts of body text count from three a page on."""
    pages = page_changes(words, size_tolerance, body_shift, list_shift)
    kinds = ["bold_added", "bold_removed", "larger", "smaller", "list_shift", "body_shift"]
    kind = lambda k: lambda c: c["change"] == k
    own = pages.select("pair_id", "page", F.explode(F.array(*[F.filter("changes", kind(k)) for k in kinds])).alias("own"))
    own = own.where((F.size("own") >= least_body) | ((F.size("own") > 0) & (F.col("own")[0]["change"] != "body_shift")))
    rows = own.select("pair_id", "page", F.posexplode(F.slice("own", 1, most)).alias("nth", "c"))
    return rows.select("pair_id", "page", *[F.col(f"c.{c}").alias(c) for c in ("para", "line", "pos", "text", "x_shift", "change")], (F.col("nth") + 1).alias("nth"))


def _quoted(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def formatting_sentences(changes: DataFrame, shown: int = 5, least_body: int = 3) -> DataFrame:
    """Changes of format_changes() or page_changes() -> (pair_id, page, formatting): one sentence per page with changes: the first
    five words of a kind, and the numbers of body words moved right and left from three a page on."""
    if "changes" not in changes.columns:
        row = F.struct("para", "line", "pos", "text", "x_shift", "e_size", "a_size", "change")
        changes = changes.repartition("pair_id", "page").groupBy("pair_id", "page").agg(F.sort_array(F.collect_list(row)).alias("changes"))
    size = lambda c: c["change"].isin("larger", "smaller")
    kind = lambda k: lambda c: size(c) if k == "size" else c["change"] == k
    word = lambda c: F.when(size(c), F.concat(_quoted(c["text"]), F.lit(" ("), c["e_size"].cast("string"), F.lit("pt→"), c["a_size"].cast("string"), F.lit("pt)"))).otherwise(_quoted(c["text"]))
    first = [F.array_join(F.transform(F.slice(F.filter("changes", kind(k)), 1, shown), word), ", ").alias(k) for k, _ in K.FORMAT_TEXTS]
    moved = lambda on: lambda c: (c["change"] == "body_shift") & on(c["x_shift"])
    counts = [F.size(F.filter("changes", moved(on))).alias(d) for d, on in (("right", lambda x: x > 0), ("left", lambda x: x < 0))]
    both = changes.select("pair_id", "page", *first, *counts)
    parts = [F.when(F.col(k) != "", F.concat(F.lit(t), F.col(k))) for k, t in K.FORMAT_TEXTS]
    enough = F.col("right") + F.col("left") >= least_body
    parts += [F.when(enough & (F.col(d) > 0), F.concat(F.col(d).cast("string"), F.lit(f" body text element(s) indented {d}"))) for d in ("right", "left")]
    # A filter on the sentence would be evaluated again on what it is made of.
    return both.select("pair_id", "page", F.explode(F.filter(F.array(F.concat_ws(" | ", *parts)), lambda x: x != "")).alias("formatting"))


def diff_summaries(changes: DataFrame, limit: int = 20, formats: DataFrame | None = None) -> DataFrame:
    """One text per page: its first changes as lines, then the formatting sentence of formats(pair_id, page,
    formatting), which stands alone on pages without text changes."""
    cut = lambda c, n: F.substring(c, 1, n)
    line = (
        F.when(F.col("kind") == "deleted", F.concat(F.lit('  REMOVED: "'), cut("expected", 120), F.lit('"')))
        .when(F.col("kind") == "inserted", F.concat(F.lit('  ADDED:   "'), cut("actual", 120), F.lit('"')))
        .when(F.col("kind") == "modified", F.concat(F.lit('  CHANGED: was="'), cut("expected", 80), F.lit('"\n           now="'), cut("actual", 80), F.lit('"')))
        .otherwise(F.concat(F.lit('  BLOCK WAS: "'), cut("expected", 100), F.lit('"\n  BLOCK NOW: "'), cut("actual", 100), F.lit('"')))
    )
    rows = changes.where(F.col("change_no") < limit).withColumn("line", line)
    texts = rows.groupBy("pair_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_no", "line"))), lambda x: x["line"]), "\n").alias("summary"))
    if formats is None:
        return texts
    head = F.when(F.col("summary").isNull(), "FORMATTING: ").otherwise("\n  FORMATTING: ")
    added = F.when(F.col("formatting").isNotNull(), F.concat(head, "formatting"))
    return texts.join(formats, ["pair_id", "page"], "full_outer").select("pair_id", "page", F.concat(F.coalesce("summary", F.lit("")), F.coalesce(added, F.lit(""))).alias("summary"))


def changed_texts(changes: DataFrame, limit: int = 25) -> DataFrame:
    """Added and removed texts of a page, paragraphs or single words: trimmed, distinct, sorted, the first 25."""
    texts = lambda c: F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.collect_list(c)), lambda x: F.trim(x)), lambda x: x != ""))), 1, limit)
    return changes.groupBy("pair_id", "page").agg(texts("added").alias("added"), texts("removed").alias("removed"))


def field_structure_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Fields added, removed or changed in type, per pair; a null type is `unknown`."""
    side = lambda df, c: df.select("pair_id", "field_name", F.coalesce("field_type", F.lit("unknown")).alias(c))
    both = side(expected, "expected_type").join(side(actual, "actual_type"), ["pair_id", "field_name"], "full_outer")
    change = F.when(F.col("actual_type").isNull(), "removed").when(F.col("expected_type").isNull(), "added").when(F.col("expected_type") != F.col("actual_type"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL")


def field_sets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Numbers of field names on one side only and on both."""
    side = lambda df, c: df.select("pair_id", "field_name").distinct().withColumn(c, F.lit(True))
    both = side(expected, "e").join(side(actual, "a"), ["pair_id", "field_name"], "full_outer")
    return both.groupBy("pair_id").agg(F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("e").isNull()).alias("added"), F.count_if(F.col("a") & F.col("e")).alias("common"))


def field_change_status(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Status of each field between two scans (pair_id, field_name, field_type, page, tab_order): unchanged,
    modified, added, removed, or renamed where a removed and an added field share page, place and type. Two null types
    are equal."""
    side = lambda df, p: df.select("pair_id", "field_name", F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in ("field_type", "page", "tab_order")])
    both = side(expected, "e").join(side(actual, "a"), ["pair_id", "field_name"], "full_outer")
    here = both.where("e_here AND a_here").select("pair_id", "field_name", F.lit(None).cast("string").alias("previous_name"), F.when(F.col("e_field_type").eqNullSafe(F.col("a_field_type")), "unchanged").otherwise("modified").alias("status"))
    gone = both.where("a_here IS NULL").select("pair_id", F.col("e_page").alias("page"), F.col("e_tab_order").alias("tab_order"), F.col("e_field_type").alias("field_type"), F.col("field_name").alias("previous_name"))
    new = both.where("e_here IS NULL").select("pair_id", F.col("a_page").alias("page"), F.col("a_tab_order").alias("tab_order"), F.col("a_field_type").alias("field_type"), "field_name")
    place = ["pair_id", "page", "tab_order", "field_type"]
    paired = gone.groupBy(*place).agg(F.min("previous_name").alias("previous_name")).join(new.groupBy(*place).agg(F.min("field_name").alias("field_name")), place)
    renamed = paired.select("pair_id", "field_name", "previous_name", F.lit("renamed").alias("status"))
    added = new.join(paired.select("pair_id", "field_name"), ["pair_id", "field_name"], "left_anti").select("pair_id", "field_name", F.lit(None).cast("string").alias("previous_name"), F.lit("added").alias("status"))
    removed = gone.join(paired.select("pair_id", "previous_name"), ["pair_id", "previous_name"], "left_anti").select("pair_id", F.col("previous_name").alias("field_name"), F.lit(None).cast("string").alias("previous_name"), F.lit("removed").alias("status"))
    return here.unionByName(renamed).unionByName(added).unionByName(removed)


def metadata_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """doc_meta(pair_id, key, value) of both sides: keys whose value differs; a missing one is empty."""
    side = lambda df, c: df.select("pair_id", "key", F.col("value").alias(c))
    both = side(expected, "expected").join(side(actual, "actual"), ["pair_id", "key"], "full_outer").fillna("", ["expected", "actual"])
    return both.where("expected <> actual")


CORNERS = ["x0", "top", "x1", "bottom"]


def graphics_diff(expected: DataFrame, actual: DataFrame, snap: float = 5.0) -> DataFrame:
    """shapes(pair_id, page, x0, top, x1, bottom): those of one side without a counterpart within the tolerance in
    all four coordinates."""
    side = lambda df, e: df.select("pair_id", "page", *CORNERS, F.lit(e).alias("e"), F.lit(1 - e).alias("a"))
    return unmatched_shapes(side(expected, 1).unionByName(side(actual, 0)), snap)


def unmatched_shapes(shapes: DataFrame, snap: float = 5.0, agg=F.sum) -> DataFrame:
    """graphics_diff of shapes(pair_id, page, x0, top, x1, bottom, e, a) that tell how often they stand on the expected and on the
    actual side; with agg F.max, equal shapes of a side are one.

    Equal shapes are one place, with its numbers of both sides. Places go to their block of the page, 20 tolerances wide in each
    coordinate, and to those that begin within the tolerance; there the places of one side look for the first of the
    other that is near, so a dense page costs no more than a thin one. What has a missing value is near to nothing."""
    width, pad = 20 * snap + 0.01, snap + 1e-6
    cells = [f"in_{c}" for c in CORNERS]
    places = shapes.select("pair_id", "page", *[F.bround(c, 1).alias(c) for c in CORNERS], "e", "a").groupBy("pair_id", "page", *CORNERS).agg(agg("e").alias("e"), agg("a").alias("a"))
    blocks, home = places, F.lit(True)
    for c, cell in zip(CORNERS, cells, strict=True):
        at = lambda d, c=c: F.floor((F.col(c) + d) / width)
        blocks = blocks.withColumn(cell, F.explode(F.array_distinct(F.array(at(-pad), at(pad)))))
        home &= F.col(cell).eqNullSafe(at(0))
    known = F.col("pair_id").isNotNull() & F.col("page").isNotNull()
    lone = ~known
    for c in CORNERS:
        lone |= F.col(c).isNull()
    alone = lambda own, other: F.collect_list(F.when(home & (F.col(own) > 0) & ((F.col(other) == 0) | lone), F.struct(*CORNERS, F.col(own).alias("n"))))
    all_of = lambda side: F.collect_list(F.when(F.col(side) > 0, F.struct(*CORNERS)))
    held = blocks.groupBy("pair_id", "page", *cells).agg(alone("e", "a").alias("removed"), alone("a", "e").alias("added"), all_of("e").alias("expected"), all_of("a").alias("actual"))

    def near(x: Column, y: Column) -> Column:
        close = [F.abs(x[c] - y[c]) <= snap + 1e-9 for c in CORNERS]
        return close[0] & close[1] & close[2] & close[3]

    def missing(change: str, others: str) -> Column:
        rows = F.filter(change, lambda x: ~F.coalesce(known & F.exists(others, lambda y: near(x, y)), F.lit(False)))
        return F.flatten(F.transform(rows, lambda x: F.array_repeat(F.struct(F.lit(change).alias("change"), *[x[c].alias(c) for c in CORNERS]), x["n"].cast("int"))))

    return held.select("pair_id", "page", F.inline(F.concat(missing("removed", "actual"), missing("added", "expected"))))


def signature_candidates(boxes: DataFrame, words: DataFrame, pad_x: float = 120.0, pad_y: float = 70.0) -> DataFrame:
    """boxes(doc_id, page, row_no, x0, y0, x1, y1, page_height, area_pct, pixels_pct): difference boxes low on the page
    and small that lie near a signature word. The words are cut to three labels before the interval join."""
    labels = words.where(F.upper(F.trim("text")).isin(K.SIGNATURE_LABELS)).select("doc_id", "page", "word_no", F.upper(F.trim("text")).alias("label"), F.col("x0").alias("wx0"), F.col("x1").alias("wx1"), "top", "bottom")
    low = boxes.where(((F.col("y0") + F.col("y1")) / 2 >= F.col("page_height") * 0.52) & ((F.col("y1") - F.col("y0")) <= F.col("page_height") * 0.16) & (F.col("area_pct") <= 3.0) & (F.col("pixels_pct") >= 0.01))
    near = (F.col("wx0") <= F.col("x1") + pad_x) & (F.col("wx1") >= F.col("x0") - pad_x) & (F.col("top") <= F.col("y1") + pad_y) & (F.col("bottom") >= F.col("y0") - pad_y)
    hits = low.join(labels, ["doc_id", "page"]).where(near)
    first = hits.groupBy("doc_id", "page", "row_no").agg(F.min_by("label", "word_no").alias("label"), F.first("area_pct").alias("area_pct"))
    return first.select("doc_id", "page", "row_no", "label", F.when(F.col("label").isin("PRESIDENT", "SECRETARY") & (F.col("area_pct") <= 1.0), "high").otherwise("medium").alias("confidence"))
