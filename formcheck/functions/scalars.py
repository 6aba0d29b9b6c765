"""Column to Column functions: pages, fields, labels, sizes, times, text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formcheck.constants import BOLD_FONT, LIST_MARKER, OTHER_SEVERITY, SEVERITIES, SIGNATURE_WORDS, WATERMARKS


def rank_of(column: Column, order: list[str], other: int) -> Column:
    """Position of a value in a list, `other` where it is not in it."""
    out = F.lit(other)
    for n, value in reversed(list(enumerate(order))):
        out = F.when(column == value, n).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return rank_of(F.lower(severity), SEVERITIES, OTHER_SEVERITY)


def severity_chip_class(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(s.isin("critical", "high"), "bad").when(s.isin("medium", "warn", "warning"), "warn").when(s.isin("low", "info"), "info").otherwise("neutral")


def status_chip_class(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s == "match", "ok").when(s == "review", "warn").when(s == "mismatch", "bad").otherwise("neutral")


def pick_first(*columns: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def safe_page(*columns: Column) -> Column:
    """First alias that is neither null nor empty, as an integer; null where it is none."""
    text = F.trim(pick_first(*[c.cast("string") for c in columns]))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def levenshtein_capped(a: Column, b: Column, limit: int = 100) -> Column:
    """Edit distance of the first `limit` characters."""
    return F.levenshtein(F.substring(a, 1, limit), F.substring(b, 1, limit))


def is_ocr_artifact(before: Column, after: Column) -> Column:
    """A one-word difference so small that it is reading noise, not a change: no space, at least five
    letters, alike in length, no digits, few edits."""
    a, b = F.trim(F.coalesce(before, F.lit(""))), F.trim(F.coalesce(after, F.lit("")))
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    few = levenshtein_capped(F.lower(a), F.lower(b)) <= F.greatest(F.lit(2), F.floor(short / 3))
    return (short >= 5) & ~F.contains(a, F.lit(" ")) & ~F.contains(b, F.lit(" ")) & (long <= short * 1.4) & ~F.concat(a, b).rlike(r"\d") & few


def safe_slug(text: Column, limit: int = 80) -> Column:
    slug = F.btrim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.substring(slug, 1, limit), F.lit("")), F.lit("test"))


def shorten(text: Column, n: int = 260) -> Column:
    s = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def truncate_block(text: Column, n: int) -> Column:
    s = F.coalesce(text, F.lit(""))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("\n[... truncated ...]"))).otherwise(s)


def escape_html(text: Column) -> Column:
    s = F.coalesce(text, F.lit(""))
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def fmt_size(size: Column) -> Column:
    """Bytes for display; halves are rounded to even."""
    kb = F.format_string("%.0f KB", F.bround(size / 1024, 0).cast("double"))
    mb = F.format_string("%.1f MB", F.bround(size / (1024 * 1024), 1).cast("double"))
    return F.when(size.isNull() | (size == 0), "—").when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size < 1024 * 1024, kb).otherwise(mb)


def fmt_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM dd, yyyy hh:mm a"), F.lit("—"))


def to_eastern(ts: Column) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, "America/New_York"), "yyyy-MM-dd 'at' HH:mm"), F.lit("—"))


def time_ago(ts: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(ts)
    unit = lambda n, suffix: F.concat(F.floor(seconds / n).cast("string"), F.lit(suffix))
    return F.when(ts.isNull(), "Never").when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def is_list_marker(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).rlike(LIST_MARKER)


def is_bold_font(font: Column) -> Column:
    return F.lower(F.coalesce(font, F.lit(""))).rlike(BOLD_FONT)


def is_watermark(text: Column) -> Column:
    """Blank, or a word of a stamp across the page."""
    word = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return (word == "") | word.isin(WATERMARKS)


def signature_like(*columns: Column) -> Column:
    """Do the scalar values of an item speak of a signature?"""
    return F.lower(F.concat_ws(" ", *columns)).rlike("|".join(SIGNATURE_WORDS))


def observation_severity(confidence: Column) -> Column:
    c = F.lower(F.coalesce(F.nullif(confidence, F.lit("")), F.lit("possible")))
    return F.when(c == "certain", "high").when(c == "likely", "medium").when(c == "possible", "low").otherwise("medium")


def csv_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def page_ranges(pages: Column) -> Column:
    """An array of pages as ranges: `1-3, 5`; `None` when it is empty. Null pages are left out."""
    ordered = F.array_sort(F.filter(pages, lambda p: p.isNotNull()))
    step = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("last"), F.array().cast("array<string>").alias("done"))
    shown = lambda a: F.when(a["start"].isNull(), a["done"]).otherwise(
        F.concat(a["done"], F.array(F.when(a["start"] == a["last"], a["start"].cast("string")).otherwise(F.concat_ws("-", a["start"].cast("string"), a["last"].cast("string")))))
    )
    merged = F.aggregate(
        ordered, step,
        lambda a, p: F.when(p == a["last"] + 1, F.struct(a["start"].alias("start"), p.cast("int").alias("last"), a["done"].alias("done"))).otherwise(F.struct(p.cast("int").alias("start"), p.cast("int").alias("last"), shown(a).alias("done"))),
        lambda a: F.array_join(shown(a), ", "),
    )
    return F.when(F.size(ordered) > 0, merged).otherwise("None")


def similarity_text(similarity: Column) -> Column:
    return F.when(similarity.isNull(), "—").otherwise(F.format_string("%.3f%%", (similarity * 100).cast("double")))


def change_hint(pattern: Column, zones: Column) -> Column:
    """Reader's hint of a change pattern (fixed texts)."""
    return (
        F.when(pattern == "no_change", "No significant visual differences detected.")
        .when(pattern == "page_wide", "Changes are spread across the entire page. This is likely a rendering, font, watermark, or DPI difference rather than specific content changes.")
        .when(pattern == "header_only", "Change confined to page header — check policy number, date, logo, or named insured field.")
        .when(pattern == "header_and_fields", "Changes in header and upper body — likely field values were populated or modified.")
        .when(pattern == "body_content", "Changes in the main body — check for text updates, inserted/deleted clauses, or field values.")
        .when(pattern == "footer_area", "Changes near the footer/signature area — check signature blocks, dates, and footer text.")
        .otherwise(F.concat(F.lit("Changes detected in: "), F.array_join(zones, ", "), F.lit(".")))
    )


def semantic_note(pct: Column, major: Column, warn: Column, hint: Column) -> Column:
    base = F.when(major, F.format_string("Significant visual differences detected (%.1f%% of pixels differ).", pct)).otherwise(F.format_string("Minor visual differences detected (%.2f%% of pixels differ).", pct))
    return F.when(major | warn, F.trim(F.concat_ws(" ", base, F.nullif(hint, F.lit(""))))).otherwise("No material visual differences detected.")


def verdict_text(summary: Column, error: Column) -> Column:
    """The assessment line of a result: FAIL with the error, FAIL or PASS by the summary's words, or Completed."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    failed = F.contains(F.lower(s), F.lit("fail"))
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("Overall Assessment: FAIL\n"), error))
        .when(s != "", F.concat(F.lit("Overall Assessment: "), F.when(failed, "FAIL").otherwise("PASS"), F.lit("\n"), s))
        .otherwise("Overall Assessment: Completed.")
    )


def compiles(expression: Column) -> Column:
    """Is it a regular expression of the engine that matches? False for null."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), expression).isNotNull()


def effective_mode(mode: Column, rules: Column) -> Column:
    """A specific check without rules is a basic one."""
    m = F.lower(F.coalesce(F.nullif(mode, F.lit("")), F.lit("basic")))
    return F.when((m == "specific") & (F.trim(F.coalesce(rules, F.lit(""))) == ""), "basic").otherwise(m)


def repair_json(raw: Column) -> Column:
    """JSON text of a model's answer: without code fences, else from the first { to the last }, else an error
    object with the first 500 characters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    valid = lambda s: F.try_parse_json(s).isNotNull()
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    inner = F.when((first > 0) & F.contains(bare, F.lit("}")) & (last > first), bare.substr(first, last - first + 1))
    error = F.to_json(F.struct(F.lit("LLM returned non-JSON response").alias("error"), F.substring(F.coalesce(raw, F.lit("")), 1, 500).alias("raw_response")))
    return F.when((bare != "") & valid(bare), bare).when(inner.isNotNull() & valid(inner), inner).otherwise(error)
