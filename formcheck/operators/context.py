"""What a request tells a model of two compared documents: the block of differences, and pages side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formcheck import constants as K


def quoted(text: Column) -> Column:
    """Text in quotes: single ones, double ones where it holds single ones alone; back slashes and line ends escaped."""
    plain = text
    for char, told in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(char), F.lit(told))
    double = F.contains(plain, F.lit("'")) & ~F.contains(plain, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _told(items: Column, order: str, text, sep: str, keep=None) -> Column:
    """Text of each struct of an array, in the order of one of its fields, joined; those that are null are left out."""
    rows = F.transform(items if keep is None else F.filter(items, keep), lambda x: F.struct(x[order].alias("o"), text(x).alias("t")))
    return F.array_join(F.transform(F.sort_array(F.filter(rows, lambda x: x["t"].isNotNull())), lambda x: x["t"]), sep)


def change_line(change: Column) -> Column:
    """Line of one change: struct of kind, expected and actual."""
    cut = lambda c, n: F.substring(F.coalesce(change[c], F.lit("")), 1, n)
    one = lambda head, c: F.concat(F.lit(head), cut(c, K.CONTEXT_LONG), F.lit('"'))
    two = lambda was, now, n: F.concat(F.lit(was), cut("expected", n), F.lit(f'"\n{now}'), cut("actual", n), F.lit('"'))
    return (
        F.when(change["kind"] == "deleted", one('    REMOVED: "', "expected"))
        .when(change["kind"] == "inserted", one('    ADDED:   "', "actual"))
        .when(change["kind"] == "modified", two('    CHANGED: was="', '             now="', K.CONTEXT_SHORT))
        .when(change["kind"] == "replaced_block", two('    BLOCK WAS: "', '    BLOCK NOW: "', K.CONTEXT_BLOCK))
    )


def page_lines(changes: Column) -> Column:
    """Lines of the first CONTEXT_CHANGES of the changes of one page: array of struct of change_no, kind, expected, actual."""
    return _told(changes, "change_no", change_line, "\n", lambda x: x["change_no"] < K.CONTEXT_CHANGES)


def change_lines(changes: DataFrame) -> DataFrame:
    """changes(pair_id, page, change_no, kind, expected, actual): (pair_id, page, lines), the first CONTEXT_CHANGES of a page."""
    first = changes.where(F.col("change_no") < K.CONTEXT_CHANGES)
    items = F.collect_list(F.struct("change_no", change_line(F.struct("kind", "expected", "actual")).alias("line")))
    return first.groupBy("pair_id", "page").agg(_told(items, "change_no", lambda x: x["line"], "\n").alias("lines"))


def page_block(row: Column, lines: Column) -> Column:
    """Text of one page: a row of compare_context_text as a struct, and the lines of its changes."""
    page = F.concat(F.lit("  Page "), F.coalesce(row["page"].cast("string"), F.lit("?")), F.lit(": "))
    status = F.when(row["major"], "MAJOR").when(row["warn"], "WARN").otherwise("OK")
    number = lambda c, other, n: F.format_string(f"%.{n}f", F.bround(F.coalesce(row[c], F.lit(other)), n))
    header = F.concat(page, status, F.lit(" | similarity="), number("similarity", 1.0, 3), F.lit(" ("), number("diff_pct", 0.0, 1), F.lit("% pixels differ)"))
    some = lambda c: F.coalesce(F.size(row[c]) > 0, F.lit(False))
    noise = ~F.coalesce(row["has_text_changes"], F.lit(False)) & ~F.coalesce(row["has_formatting_changes"], F.lit(False)) & (row["major"] | row["warn"])
    parts = [header, F.when(lines.isNotNull(), F.concat(F.lit(K.CONTEXT_LINES + "\n"), lines)).when(noise, K.CONTEXT_SAME_TEXT)]
    for name, head in K.CONTEXT_LISTS:
        # Sizes are told as they are, words in quotes.
        words = F.slice(row[name], 1, K.CONTEXT_WORDS)
        listed = F.array_join(words if name == "size_changed" else F.transform(words, quoted), ", ")
        parts.append(F.when(some(name), F.concat(F.lit(head), listed)))
    other = F.coalesce(row["formatting"], F.lit("")) != ""
    parts.append(F.when(other & ~(some("bold_changed") | some("size_changed") | some("list_shifted")), F.concat(F.lit(K.CONTEXT_FORMATTING), row["formatting"])))
    parts.append(F.when(F.coalesce(row["graphics"], F.lit("")) != "", F.concat(F.lit(K.CONTEXT_GRAPHICS), row["graphics"])))
    parts.append(F.when(row["signature_label"].isNotNull(), F.format_string(K.CONTEXT_SIGNATURE, row["signature_label"])))
    inserted = F.when(F.coalesce(row["is_blank"], F.lit(False)), K.CONTEXT_BLANK).otherwise(K.CONTEXT_INSERTED)
    return F.when(row["op"] == "deleted", F.concat(page, F.lit(K.CONTEXT_DELETED))).when(row["op"] == "inserted", F.concat(page, inserted)).otherwise(F.concat_ws("\n", *parts))


def document_text(metadata: Column, fields: Column) -> Column:
    """Changed properties, then fields that went, came or changed their type (of these the first few), names in their order; null
    where both arrays are null or empty. metadata: structs of key, expected, actual; fields: structs of field_name,
    status removed|added|type_changed, expected_type, actual_type."""
    told = lambda c: F.coalesce(c, F.lit(""))
    some = lambda items: F.coalesce(F.size(items) > 0, F.lit(False))
    entry = lambda x: F.concat(F.lit("  "), x["key"], F.lit(": '"), told(x["expected"]), F.lit("' → '"), told(x["actual"]), F.lit("'"))
    properties = F.when(some(metadata), F.concat(F.lit(K.CONTEXT_METADATA + "\n"), _told(metadata, "key", entry, "\n")))
    kind = lambda x: F.concat(F.lit(K.CONTEXT_TYPE + "'"), x["field_name"], F.lit("' "), told(x["expected_type"]), F.lit(" → "), told(x["actual_type"]))
    names = lambda status: _told(fields, "field_name", lambda x: x["field_name"], ", ", lambda x: x["status"] == status)
    typed = F.transform(F.filter(fields, lambda x: x["status"] == "type_changed"), lambda x: F.struct(x["field_name"], kind(x).alias("told")))
    types = F.array_join(F.transform(F.slice(F.sort_array(typed), 1, K.CONTEXT_TYPES), lambda x: x["told"]), "\n")
    lists = F.array(*[F.struct(F.lit(head).alias("head"), text.alias("text")) for head, text in ((K.CONTEXT_REMOVED, names("removed")), (K.CONTEXT_ADDED, names("added")), ("", types))])
    line = F.transform(F.filter(lists, lambda x: x["text"] != ""), lambda x: F.concat(x["head"], x["text"]))
    structure = F.when(some(fields), F.concat_ws("\n", F.lit(K.CONTEXT_FIELDS), line))
    return F.when(some(metadata) | some(fields), F.concat_ws("\n", F.lit(K.CONTEXT_DOCUMENT), properties, structure))


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): the rows of a pair as an array of structs."""
    return rows.groupBy("pair_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "pair_id"])).alias(name))


def pair_contexts(pairs: DataFrame) -> DataFrame:
    """(pair_id, context) of pairs(pair_id, rows, lines, metadata, fields) that stand together already: arrays of structs with
    the columns of compare_context_text, and a map from page to the lines of its changes (see page_lines). Nothing is
    shuffled; null arrays are empty."""
    line = lambda x: F.when(x["page"].isNotNull(), F.col("lines")[x["page"]])
    told = F.filter("rows", lambda x: F.coalesce(x["op"], F.lit("matched")) != "single")
    both = F.array(_told(told, "row_no", lambda x: page_block(x, line(x)), "\n\n"), document_text(F.col("metadata"), F.col("fields")))
    # A text of its own column is made once, though it is looked at twice.
    context = pairs.select("pair_id", F.array_join(F.filter(both, lambda x: x != ""), "\n\n").alias("context"))
    return context.select("pair_id", F.when(F.col("context") == "", K.CONTEXT_EMPTY).otherwise(F.col("context")).alias("context"))


def compare_context_text(rows: DataFrame, changes: DataFrame, metadata: DataFrame, fields: DataFrame) -> DataFrame:
    """(pair_id, context): the block of differences of each pair, page after page, then what concerns the whole document.

    rows(pair_id, row_no, page, op, similarity, diff_pct, major, warn, is_blank, has_text_changes, has_formatting_changes,
    formatting, bold_changed, size_changed, list_shifted (arrays of strings), graphics, signature_label): pages without a
    comparison have the op single and are left out. For changes see change_lines, for metadata(pair_id, ...) and
    fields(pair_id, ...) document_text. A pair of which nothing is told has a fixed text. A group is one pair: bounded by
    its pages. Everything is brought together by pair_id alone."""
    entry = F.struct(F.col("page").cast(rows.schema["page"].dataType).alias("page"), "lines")
    lines = change_lines(changes).where("page IS NOT NULL").groupBy("pair_id").agg(F.map_from_entries(F.collect_list(entry)).alias("lines"))
    documents = _listed(metadata, "metadata").join(_listed(fields, "fields"), "pair_id", "full_outer")
    return pair_contexts(_listed(rows, "rows").join(lines, "pair_id", "left").join(documents, "pair_id", "full_outer"))


def page_image_pairs(aligned: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, row_no, op, expected_image, actual_image, label): baseline page beside the page it was aligned to; one side is
    null for deleted and inserted pages. Where a pair has no alignment at all its pages stand side by side by their
    numbers (op `page`). pages(pair_id, side, page, image)."""
    side = lambda df, s: df.where(F.col("side") == s).select("pair_id", F.col("page").alias(f"{s}_page"), F.col("image").alias(f"{s}_image"))
    e, a = F.col("expected_page").cast("string"), F.col("actual_page").cast("string")
    label = F.when(F.col("op") == "deleted", F.format_string(K.IMAGE_DELETED, e)).when(F.col("op") == "inserted", F.format_string(K.IMAGE_INSERTED, a)).otherwise(F.format_string(K.IMAGE_MATCHED, e, a))
    met = aligned.join(side(pages, "expected"), ["pair_id", "expected_page"], "left").join(side(pages, "actual"), ["pair_id", "actual_page"], "left").select("pair_id", "row_no", "op", "expected_image", "actual_image", label.alias("label"))
    rest = pages.join(aligned.select("pair_id").distinct(), "pair_id", "left_anti")
    numbered = lambda s: side(rest, s).withColumnRenamed(f"{s}_page", "page")
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy("page"))
    plain = numbered("expected").join(numbered("actual"), ["pair_id", "page"], "full_outer")
    plain = plain.select("pair_id", nth.alias("row_no"), F.lit("page").alias("op"), "expected_image", "actual_image", F.format_string(K.IMAGE_PAGE, F.col("page").cast("string")).alias("label"))
    return met.unionByName(plain)
