"""Checks on documents: text assembly, accessibility, field inventory, and deterministic rules.

doc_pages(doc_id, page, text, source); doc_fields(doc_id, field_name, field_type, field_value, label, tooltip, page,
tab_order); doc_meta(doc_id, key, value); rules(rule_id, doc_scope, kind, field_name, op, arg1, arg2, cond_field,
cond_value).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formcheck import constants as K
from formcheck.functions import scalars as S

PLACEHOLDER = r"(?i)lorem ipsum|\btest data\b|\bsample\b|\btbd\b|\bn/a\b|\[insert"


def _joined(item: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", item.alias("t")))), lambda x: x["t"]), sep)


def document_text(pages: DataFrame, headers: bool = False) -> DataFrame:
    """Non-empty page texts of a document in page order, with a blank line between; optionally with headers."""
    text = F.trim("text")
    item = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), text) if headers else text
    return pages.where(text != "").groupBy("doc_id").agg(_joined(item, "\n\n").alias("text"))


def choose_text_source(pages: DataFrame) -> DataFrame:
    """pages with text_embedded and text_ocr: the embedded text where it has one."""
    embedded, ocr = F.nullif(F.trim("text_embedded"), F.lit("")), F.nullif(F.trim("text_ocr"), F.lit(""))
    return pages.select("doc_id", "page", F.coalesce(embedded, ocr, F.lit("")).alias("text"), F.when(embedded.isNotNull(), "embedded").when(ocr.isNotNull(), "ocr").otherwise("none").alias("source"))


def scan_meta(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: pages, words, words a page, sparse (under 50 a page), looks scanned (no or sparse text, no fields)."""
    words = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    per = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(words).alias("words"))
    rows = per.join(fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields")), "doc_id", "left").fillna(0, ["fields"])
    average = F.bround(F.col("words") / F.col("pages"), 1)
    rows = rows.withColumn("avg_words", average).withColumn("sparse", (F.col("words") > 0) & (F.col("avg_words") < 50))
    return rows.withColumn("scanned_like", ((F.col("words") == 0) | F.col("sparse")) & (F.col("fields") == 0))


def page_inventory(pages: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per page: words, shapes of each kind, labels that occur."""
    kinds = shapes.groupBy("doc_id", "page").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("image", "line", "rect", "curve")])
    upper = F.upper("text")
    rows = pages.select("doc_id", "page", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("words"), *[F.contains(upper, F.lit(w)).alias(f"has_{w.lower().replace(' ', '_')}") for w in ("PRESIDENT", "SECRETARY", "SIGNATURE", "NAMED INSURED")])
    return rows.join(kinds, ["doc_id", "page"], "left").fillna(0, ["images", "lines", "rects", "curves"])


def find_text_bbox(words: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """targets(target_id, doc_id, page, text): box of the first place where its tokens follow one another in the
    page's words, else of the first word that contains its longest token (the first of these) of five letters or more.
    words(doc_id, page, word_no, text, x0, x1, top, bottom), or pages of both (doc_id, page, words, targets) alone: these are
    looked up where they stand. Memory is that of a page.

    A page's words are one string, each between line feeds, so a place is found by one string search."""
    text = lambda w: F.translate(F.lower(F.coalesce(w["text"], F.lit(""))), "\n", " ")
    if targets is None:
        pages = words.where("doc_id IS NOT NULL AND page IS NOT NULL")
    else:
        own = F.struct("word_no", "text", "x0", "x1", "top", "bottom")
        pages = words.groupBy("doc_id", "page").agg(F.collect_list(own).alias("words"))
        pages = targets.select("doc_id", "page", F.array(F.struct("target_id", "text")).alias("targets")).join(pages, ["doc_id", "page"])
    word = lambda w: F.struct(w["word_no"].alias("word_no"), text(w).alias("text"), *[w[c].alias(c) for c in ("x0", "x1", "top", "bottom")])
    pages = pages.select("doc_id", "page", "targets", F.sort_array(F.transform("words", word)).alias("w"))
    pages = pages.select("doc_id", "page", "targets", "w", F.concat(F.lit("\n"), F.array_join(F.transform("w", lambda x: x["text"]), "\n"), F.lit("\n")).alias("whole"))
    tokens = lambda t: F.filter(F.split(F.lower(F.trim(t["text"])), r"\s+"), lambda x: x != "")
    longest = lambda all_: F.aggregate(all_, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a), lambda a: F.when(F.length(a) >= 5, a))
    place = lambda c: F.nullif(F.position(c, F.col("whole")), F.lit(0))
    run = lambda all_: F.concat(F.lit("\n"), F.array_join(all_, "\n"), F.lit("\n"))
    wanted = F.filter(F.transform("targets", lambda t: F.struct(t["target_id"].alias("target_id"), tokens(t).alias("tokens"))), lambda t: F.size(t["tokens"]) > 0)
    told = F.transform(wanted, lambda t: F.struct(t["target_id"].alias("target_id"), place(run(t["tokens"])).alias("start"), t["tokens"].alias("tokens")))
    # Only where the tokens do not follow one another is the longest looked for.
    told = F.transform(told, lambda t: F.struct(t["target_id"].alias("target_id"), t["start"].alias("start"), F.size(t["tokens"]).alias("n"), F.when(t["start"].isNotNull(), t["start"]).otherwise(place(longest(t["tokens"]))).alias("at")))
    before = lambda t: F.substring(F.col("whole"), F.lit(1), t["at"])
    number = lambda t: F.length(before(t)) - F.length(F.replace(before(t), F.lit("\n"), F.lit("")))
    hits = F.transform(F.filter(told, lambda t: t["at"].isNotNull()), lambda t: F.struct(t["target_id"].alias("target_id"), t["start"].alias("start"), F.slice("w", number(t), F.when(t["start"].isNotNull(), t["n"]).otherwise(1)).alias("hit")))
    side = lambda of, t, c: of(F.transform(t["hit"], lambda x: x[c])).alias(c)
    box = lambda t: [side(F.array_min, t, "x0"), side(F.array_min, t, "top"), side(F.array_max, t, "x1"), side(F.array_max, t, "bottom")]
    rows = F.transform(hits, lambda t: F.struct(t["target_id"].alias("target_id"), F.when(t["start"].isNotNull(), "sequence").otherwise("word").alias("found_by"), *box(t)))
    return pages.select("doc_id", "page", F.inline(rows)).select("target_id", "doc_id", "page", "found_by", "x0", "top", "x1", "bottom")


def request_rows(test_cases: DataFrame, texts: DataFrame, page_texts: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """One inference request per test case(test_case_id, doc_id, mode, rules): effective mode, document text and, if
    page_texts(doc_id, pages) and fields(doc_id, field_name, field_value) are given, page texts and fields as JSON.
    Texts are cut at the mode's limits; a benchmark request marks the cut. Fields are never cut."""
    rows = test_cases.join(texts.select("doc_id", "text"), "doc_id", "left")
    if page_texts is not None:
        rows = rows.join(page_texts.select("doc_id", "pages"), "doc_id", "left")
    if fields is not None:
        lists = fields.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field_name", "field_value")))).alias("fields"))
        rows = rows.join(lists, "doc_id", "left")
    rows = rows.withColumn("mode", S.effective_mode(F.col("mode"), F.col("rules")))

    def cut(column: str, k: int) -> Column:
        text, limits = F.coalesce(column, F.lit("")), K.TEXT_LIMITS
        plain = F.when(F.col("mode") == "specific", F.substring(text, 1, limits["specific"][k])).otherwise(F.substring(text, 1, limits["basic"][k]))
        return F.when(F.col("mode") == "benchmark", S.truncate_block(text, limits["benchmark"][k])).otherwise(plain).alias(column)

    more = [] if page_texts is None else [cut("pages", 1)]
    more += [] if fields is None else [F.coalesce("fields", F.lit("[]")).alias("fields")]
    return rows.select("test_case_id", "doc_id", "mode", cut("text", 0), *more)


def _issue(rows: DataFrame, kind: str, field: Column | None = None, page: Column | None = None) -> DataFrame:
    """Findings of a kind; its text names the field or the page, if it has a place for one."""
    severity, criterion, text = K.ACCESSIBILITY[kind]
    named = [c.cast("string") for c in (field, page) if c is not None]
    told = F.format_string(text, *named) if "%s" in text else F.lit(text)
    null = F.lit(None)
    return rows.select("doc_id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (null if field is None else field).cast("string").alias("field_name"), (null if page is None else page).cast("int").alias("page"), told.alias("description"), F.lit(criterion).alias("wcag_criterion"))


def missing_label(fields: DataFrame, most: int = 10) -> DataFrame:
    label = F.trim(S.pick_first(F.col("label"), F.col("tooltip"), F.lit(" ")))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("tab_order", "field_name"))
    rows = fields.where(F.length(label) < 2).withColumn("nth", nth).where(F.col("nth") <= most)
    return _issue(rows, "missing_label", F.col("field_name"))


def _meta(docs: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    values = meta.where(F.col("key").isin(keys)).groupBy("doc_id").agg(F.max(F.nullif(F.trim("value"), F.lit(""))).alias("value"))
    return docs.select("doc_id").distinct().join(values, "doc_id", "left")


def missing_language(docs: DataFrame, meta: DataFrame) -> DataFrame:
    return _issue(_meta(docs, meta, ["language", "lang"]).where("value IS NULL"), "missing_language")


def missing_title(docs: DataFrame, meta: DataFrame) -> DataFrame:
    return _issue(_meta(docs, meta, ["title"]).where("value IS NULL OR lower(value) = 'untitled'"), "missing_title")


def unlabeled_signature(fields: DataFrame) -> DataFrame:
    rows = fields.where(F.col("field_name").rlike(K.SIGNATURE_FIELD) & (F.coalesce("label", F.lit("")) == ""))
    return _issue(rows, "unlabeled_signature", F.col("field_name"))


def image_only_page(pages: DataFrame) -> DataFrame:
    rows = pages.where(F.length(F.trim("text")) < 20)
    return _issue(rows, "image_only_page", page=F.col("page"))


def unexplained_required(texts: DataFrame) -> DataFrame:
    rows = texts.where(F.col("text").rlike(K.REQUIRED_MARK) & ~F.col("text").rlike(K.REQUIRED_TOLD))
    return _issue(rows, "unexplained_required_indicator")


def check_accessibility(pages: DataFrame, fields: DataFrame, meta: DataFrame) -> DataFrame:
    """All accessibility findings of the documents in pages."""
    parts = [missing_label(fields), missing_language(pages, meta), missing_title(pages, meta), unlabeled_signature(fields), image_only_page(pages), unexplained_required(document_text(pages))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_field_inventory(extractions: DataFrame) -> DataFrame:
    """extractions(doc_id, fields map<string,string>) -> inventory rows with flags."""
    rows = extractions.select("doc_id", F.explode("fields").alias("field_name", "value"))
    return rows.select("doc_id", "field_name", "value", (F.length(F.trim(F.coalesce("value", F.lit("")))) >= 2).alias("has_label"), F.col("field_name").rlike(r"(?i)\*|required").alias("is_required"))


def field_inventory_view(fields: DataFrame) -> DataFrame:
    """Fields by (page, name) with the document's totals: all, without label, required."""
    w = Window.partitionBy("doc_id")
    return fields.select("doc_id", "page", "field_name", F.count(F.lit(1)).over(w).alias("total"), F.count_if(F.coalesce("label", F.lit("")) == "").over(w).alias("unlabeled"), F.count_if(F.col("is_required")).over(w).alias("required"))


def _violations(rows: DataFrame, bucket: str) -> DataFrame:
    return rows.select("doc_id", "rule_id", F.lit(bucket).alias("bucket"), "field_name", F.col("arg1").alias("expected"), F.col("field_value").alias("actual"))


def follows_format(value: Column, wanted: Column) -> Column:
    """Does the value follow a named format (dates that exist, e-mail, phone, postal code, currency) or else a regular
    expression? A null expression is followed by nothing, an empty one by everything."""
    out = F.coalesce(F.regexp_like(value, F.when(wanted.isin(*K.DATE_FORMATS, *K.NAMED_PATTERNS), "").otherwise(wanted)), F.lit(False))
    for name, layout in K.DATE_FORMATS.items():
        out = F.when(wanted == name, (F.length(value) == len(layout)) & F.try_to_timestamp(value, F.lit(layout)).isNotNull()).otherwise(out)
    for name, expression in K.NAMED_PATTERNS.items():
        out = F.when(wanted == name, value.rlike(expression)).otherwise(out)
    return out


def check_rules(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per failed rule. Kinds: exact, pattern (arg1 a regular expression or a named format), date_range (arg1 to arg2),
    signature, selection, conditional (cond_field = cond_value implies field = arg1). Rules are joined on the
    field's name; a rule for all documents has a null doc_scope. Compares as text; a missing value is empty. A pattern
    that does not compile is left out."""
    value = F.coalesce("field_value", F.lit(""))
    rules = rules.where((F.coalesce("kind", F.lit("")) != "pattern") | F.col("arg1").isNull() | S.compiles(F.col("arg1")))
    rules = rules.select("rule_id", "doc_scope", "kind", "field_name", "arg1", "arg2", "cond_field", "cond_value")
    # Rules of one document meet that document alone.
    scoped = rules.where("doc_scope IS NOT NULL").withColumn("doc_id", F.col("doc_scope").cast(fields.schema["doc_id"].dataType))
    rows = fields.join(rules.where("doc_scope IS NULL"), "field_name").unionByName(fields.join(scoped, ["doc_id", "field_name"]))
    of = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    exact = _violations(of("exact", "selection").where(value != F.coalesce("arg1", F.lit(""))), "value_mismatches")
    pattern = _violations(of("pattern").where(~follows_format(value, F.col("arg1"))), "format_issues")
    day = lambda c: F.col(c).try_cast("date")
    dates = _violations(of("date_range").where(~F.coalesce(day("field_value").between(day("arg1"), day("arg2")), F.lit(False))), "format_issues")
    signature = _violations(of("signature").where(F.trim(value) == ""), "missing_content")
    other = fields.select("doc_id", F.col("field_name").alias("cond_field"), F.col("field_value").alias("cond_value"))
    conditional = _violations(of("conditional").where(value != F.coalesce("arg1", F.lit(""))).join(other, ["doc_id", "cond_field", "cond_value"], "left_semi"), "compliance_issues")
    return exact.unionByName(pattern).unionByName(dates).unionByName(signature).unionByName(conditional)


def assert_calculation(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """rules(rule_id, field_name, op sum|product|percent, operands): fields that differ from the sum or product of others,
    or from the first operand's per cent of the second."""
    number = F.col("field_value").try_cast("double")
    parts = rules.select("rule_id", "op", F.explode(S.csv_tokens(F.col("operands"))).alias("field_name")).join(fields.select("doc_id", "field_name", number.alias("v")), "field_name")
    result = parts.groupBy("doc_id", "rule_id", "op").agg(F.sum("v").alias("s"), F.product("v").alias("p")).select("doc_id", "rule_id", F.when(F.col("op") == "product", F.col("p")).when(F.col("op") == "percent", F.col("p") / 100).otherwise(F.col("s")).alias("expected"))
    own = rules.select("rule_id", "field_name").join(fields.select("doc_id", "field_name", number.alias("actual")), "field_name")
    return own.join(result, ["doc_id", "rule_id"]).where(F.abs(F.col("actual") - F.col("expected")) > 1e-6).select("doc_id", "rule_id", F.lit("value_mismatches").alias("bucket"), "field_name", "expected", "actual")


def placeholder_text(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("text").rlike(PLACEHOLDER)).select("doc_id", "page", F.lit("format_issues").alias("bucket"), F.lit("high").alias("severity"))


def duplicate_labels(fields: DataFrame) -> DataFrame:
    rows = fields.where(F.coalesce("label", F.lit("")) != "").groupBy("doc_id", "page", "label").agg(F.count(F.lit(1)).alias("times"))
    return rows.where("times > 1").select("doc_id", "page", "label", "times", F.lit("medium").alias("severity"))


def label_style_outliers(fields: DataFrame) -> DataFrame:
    """Labels whose capitalisation or final colon differs from their document's majority (ties: the smaller style)."""
    style = F.concat_ws("/", F.when(F.col("label") == F.upper("label"), "upper").when(F.col("label") == F.lower("label"), "lower").otherwise("mixed"), F.when(F.col("label").endswith(":"), "colon").otherwise("plain"))
    rows = fields.where(F.coalesce("label", F.lit("")) != "").select("doc_id", "field_name", "label", style.alias("style"))
    counts = rows.groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("doc_id").agg(F.min_by("style", F.struct((-F.col("n")).alias("n"), "style")).alias("usual"))
    return rows.join(usual, "doc_id").where("style <> usual")


def number_gaps(numbers: DataFrame) -> DataFrame:
    """numbers(doc_id, value and, if given, kind): places where a document's numbering of a kind skips values. A gap
    in the kind `page` is missing content of medium severity, another a format issue of low severity."""
    rows = numbers.select("doc_id", "value", F.col("kind") if "kind" in numbers.columns else F.lit("list").alias("kind")).distinct()
    gaps = rows.withColumn("next", F.lead("value").over(Window.partitionBy("doc_id", "kind").orderBy("value"))).where("next - value > 1")
    page = F.col("kind") == "page"
    return gaps.select("doc_id", F.col("value").alias("after"), F.col("next").alias("before"), "kind", F.when(page, "missing_content").otherwise("format_issues").alias("bucket"), F.when(page, "medium").otherwise("low").alias("severity"))


def _most_frequent(rows: DataFrame, items: dict[str, Column]) -> DataFrame:
    """Rows with the most frequent item of each array, of equally frequent ones the smallest; a null is an item, too. Each step is a column
    of its own, else it would be made again for each of its items."""
    own = rows.columns
    rows = rows.select(*own, *[F.sort_array(items[c]).alias(f"{c}_sorted") for c in items])
    begins = lambda c: F.array_compact(F.transform(f"{c}_sorted", lambda x, k: F.when((k == 0) | ~x.eqNullSafe(F.get(f"{c}_sorted", k - 1)), k)))
    rows = rows.select("*", *[begins(c).alias(f"{c}_begins") for c in items])
    end = lambda c, n: F.coalesce(F.get(f"{c}_begins", n + 1), F.size(f"{c}_sorted"))
    most = lambda c: F.array_min(F.transform(f"{c}_begins", lambda k, n: F.struct((k - end(c, n)).alias("n"), F.get(f"{c}_sorted", k).alias("item"))))["item"]
    return rows.select(*own, *[most(c).alias(c) for c in items])


def font_outliers(words: DataFrame) -> DataFrame:
    """Words whose size is over two points off their document's usual one, or whose font family differs; under eight
    points is low, under six high. words(doc_id, page, word_no, text, size, fontname), or documents of them (doc_id, words): these
    are looked through where they stand, so the memory is that of a document."""
    family = lambda w: F.split(w["fontname"], "-")[0]

    def severity(w: Column, size: Column, usual: Column) -> Column:
        return F.when(w["size"] < 6, "high").when(family(w) != usual, "high").when(F.abs(w["size"] - size) > 2, "medium").when(w["size"] < 8, "low")

    if "words" in words.columns:
        items = {"usual_size": F.transform("words", lambda w: w["size"]), "usual_family": F.transform("words", family)}
        rows = _most_frequent(words.where("doc_id IS NOT NULL").select("doc_id", "words"), items)
        judged = lambda w: F.struct(*[w[c].alias(c) for c in ("page", "word_no", "text", "size")], severity(w, F.col("usual_size"), F.col("usual_family")).alias("severity"))
        return rows.select("doc_id", F.inline(F.filter(F.transform("words", judged), lambda w: w["severity"].isNotNull())))
    whole = F.struct("size", "fontname")
    counts = words.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), "size")).alias("usual_size"))
    fonts = words.groupBy("doc_id", family(whole).alias("family")).agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.min_by("family", F.struct((-F.col("n")).alias("n"), "family")).alias("usual_family"))
    rows = words.join(counts, "doc_id").join(fonts, "doc_id")
    rows = rows.withColumn("severity", severity(whole, F.col("usual_size"), F.col("usual_family")))
    return rows.where("severity IS NOT NULL").select("doc_id", "page", "word_no", "text", "size", "severity")


def layout_outliers(boxes: DataFrame, share: float = 0.15, margin: float = 0.0, page_width: float = 612.0) -> DataFrame:
    """boxes(doc_id, page, box_id, kind, x0, top, x1, bottom): width over 15 % off the median of its kind on the document,
    or outside the page's margins."""
    width = F.col("x1") - F.col("x0")
    middle = boxes.groupBy("doc_id", "kind").agg(F.percentile(width, 0.5).alias("usual"))
    reason = F.when((F.col("x0") < margin) | (F.col("x1") > page_width - margin), "outside margin").when(F.abs(width - F.col("usual")) > F.col("usual") * share, "width")
    return boxes.join(middle, ["doc_id", "kind"]).withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "page", "box_id", "reason")


def swept_pairs(x0: np.ndarray, x1: np.ndarray, top: np.ndarray, bottom: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes whose areas overlap, by a sweep from left to right: a box meets those that begin before it ends, which
    stand next to it in the order of left sides. `at_once` bounds the meetings held at a time."""
    order = np.argsort(x0, kind="stable")
    x0, x1, top, bottom = x0[order], x1[order], top[order], bottom[order]
    n = len(order)
    met = np.searchsorted(x0, x1, "left") - np.arange(n) - 1
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = 0
    total = np.cumsum(met)
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_once, "right")))
        size = met[begin:end]
        a = np.repeat(np.arange(begin, end), size)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        on = (np.maximum(top[a], top[b]) < np.minimum(bottom[a], bottom[b])) & (x0[b] < x1[a])
        left.append(order[a[on]])
        right.append(order[b[on]])
        begin = end
    return np.concatenate(left), np.concatenate(right)


def overlapping_boxes(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes (box_id < other_id) of a page whose areas overlap; boxes that only touch do not, nor boxes without an
    area or with missing sides. Each page is swept once, whatever the size and scale of its boxes; what is written out is
    the pairs there are."""
    rows = boxes.where("x0 < x1 AND top < bottom").select("doc_id", "page", "box_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")]).distinct()
    # A group is the boxes of one page.
    pages = rows.groupBy("doc_id", "page").agg(F.collect_list(F.struct("box_id", "x0", "x1", "top", "bottom")).alias("boxes")).where(F.size("boxes") > 1)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def met(x0: pd.Series, x1: pd.Series, top: pd.Series, bottom: pd.Series) -> pd.Series:
        out = []
        for page in zip(x0, x1, top, bottom, strict=True):
            a, b = swept_pairs(*(np.asarray(side, np.float64) for side in page))
            out.append([{"a": i, "b": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        return pd.Series(out)

    side = lambda c: F.transform("boxes", lambda b: b[c])
    hits = pages.select("doc_id", "page", side("box_id").alias("ids"), F.explode(met(*map(side, ("x0", "x1", "top", "bottom")))).alias("m"))
    one, two = F.col("ids")[F.col("m.a")], F.col("ids")[F.col("m.b")]
    pairs = hits.select("doc_id", "page", F.least(one, two).alias("box_id"), F.greatest(one, two).alias("other_id"))
    return pairs.where("box_id < other_id").distinct().withColumn("severity", F.lit("high"))


def required_empty(fields: DataFrame) -> DataFrame:
    rows = fields.where(F.col("is_required") & (F.trim(F.coalesce("field_value", F.lit(""))) == ""))
    return rows.select("doc_id", "field_name", F.lit("missing_content").alias("bucket"), F.lit("critical").alias("severity"))


def watermark_once(words: DataFrame) -> DataFrame:
    """The first stamp word of each document; of words at one place the least."""
    rows = words.where(S.is_watermark(F.col("text")) & (F.trim("text") != ""))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("page", F.upper(F.trim("text")).alias("stamp")), F.struct("page", "word_no", F.upper(F.trim("text")).alias("stamp"))).alias("x")).select("doc_id", "x.page", "x.stamp")
