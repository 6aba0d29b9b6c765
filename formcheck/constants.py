"""Bucket lists, severities, thresholds, display words.

They must equal those of the behaviour that is reproduced; list order matters where findings are numbered
or ties are broken, and it differs per operator.
"""

from __future__ import annotations

# Result document.
LIST_KEYS = [
    "spelling_errors", "format_issues", "value_mismatches", "missing_content", "extra_content", "layout_anomalies", "typography_issues",
    "structural_changes", "compliance_issues", "visual_mismatches", "accessibility_issues", "pages_impacted", "top_findings", "visual_validation",
]

# Buckets of one operator each.
SUMMARY_BUCKETS = [
    "spelling_errors", "format_issues", "value_mismatches", "missing_content", "extra_content", "layout_anomalies", "typography_issues",
    "structural_changes", "visual_mismatches",
]
PAGE_BUCKETS = [*SUMMARY_BUCKETS, "compliance_issues", "accessibility_issues"]
REVIEW_BUCKETS = [
    "spelling_errors", "format_issues", "value_mismatches", "missing_content", "extra_content", "layout_anomalies", "compliance_issues", "visual_mismatches",
]
ERROR_BUCKETS = ["spelling_errors", "format_issues", "value_mismatches", "missing_content", "compliance_issues", "visual_mismatches", "structural_changes"]
WARNING_BUCKETS = ["extra_content", "layout_anomalies", "typography_issues", "accessibility_issues"]
BATCH_ERROR_BUCKETS = ["spelling_errors", "format_issues", "value_mismatches", "missing_content", "compliance_issues", "visual_mismatches"]
BATCH_WARNING_BUCKETS = ["extra_content", "layout_anomalies"]
ISSUE_BUCKETS = [
    ("value_mismatches", "Value difference", "critical"), ("missing_content", "Missing content", "high"), ("extra_content", "Extra content", "medium"),
    ("layout_anomalies", "Layout difference", "medium"), ("format_issues", "Format issue", "low"), ("spelling_errors", "Spelling issue", "low"),
    ("compliance_issues", "Compliance issue", "high"), ("visual_mismatches", "Visual difference", "high"),
]
MISMATCH_BUCKETS = ["value_mismatches", "missing_content", "extra_content", "compliance_issues", "visual_mismatches"]
BUSINESS_BUCKETS = ["value_mismatches", "missing_content", "extra_content", "compliance_issues"]
CRITICAL_BUCKETS = ["value_mismatches", "missing_content", "compliance_issues"]
CLASSIFIED_BUCKETS = [
    "visual_mismatches", "missing_content", "extra_content", "value_mismatches", "format_issues", "layout_anomalies", "structural_changes",
    "spelling_errors", "typography_issues",
]
OUT_OF_SPECIFIC = [
    "spelling_errors", "format_issues", "extra_content", "layout_anomalies", "typography_issues", "accessibility_issues", "visual_mismatches",
    "structural_changes",
]

# Severities.
SEVERITIES = ["critical", "high", "medium", "low"]
OTHER_SEVERITY = 9

# Thresholds.
REVIEW_SIMILARITY = 0.9985
SIGNATURE_SIMILARITY = 0.9990
MAJOR_PCT, WARN_PCT = 2.0, 0.10
PAGE_WIDE_CLEAR_BOTH, PAGE_WIDE_CLEAR_MAJOR = 1.0, 5.0
ZONE_SIGNIFICANT = 1.5
ZONES = [("header", 0.0, 0.12), ("upper_body", 0.12, 0.42), ("middle_body", 0.42, 0.72), ("lower_body", 0.72, 0.87), ("footer", 0.87, 1.0)]
STUCK_MINUTES = 15

# Words.
WATERMARKS = ["SPECIMEN", "SAMPLE", "DRAFT", "VOID", "COPY", "CONFIDENTIAL", "DUPLICATE", "CANCELLED", "CANCELED", "SUPERSEDED"]
SIGNATURE_WORDS = ["signature", "president", "secretary", "approval", "signed"]
SIGNATURE_LABELS = ["PRESIDENT", "SECRETARY", "SIGNATURE"]

# Weights of red, green and blue in a grey value, times 65536.
LUMA = [19595, 38470, 7471]

# Openings of the formatting sentence, in order.
FORMAT_TEXTS = [
    ("bold_added", "Text became bold: "), ("bold_removed", "Text lost bold: "), ("size", "Font size changed: "),
    ("list_shift", "List marker(s) alignment shifted: "),
]

# Characters of document text and of page texts in a request, by mode.
TEXT_LIMITS = {"basic": (5000, 3000), "specific": (5000, 3000), "benchmark": (6000, 4000)}

#: Named formats of pattern rules: dates by the engine's format, others by expression.
DATE_FORMATS = {"MM/DD/YYYY": "MM/dd/yyyy", "DD/MM/YYYY": "dd/MM/yyyy", "YYYY-MM-DD": "yyyy-MM-dd"}
NAMED_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^\+?[0-9][0-9 ().-]{6,18}[0-9]$", "postal": r"^([0-9]{5}(-[0-9]{4})?|[A-Za-z][0-9][A-Za-z] ?[0-9][A-Za-z][0-9])$",
    "currency": r"^[$€£]?\s?-?[0-9]{1,3}((,[0-9]{3})*|[0-9]*)(\.[0-9]{2})?$",
}

# Texts of the block of differences in a request, and how many entries or characters of each kind it shows.
CONTEXT_EMPTY = "No visual diff data available."
CONTEXT_DELETED = "DELETED — entire page removed from current PDF."
CONTEXT_BLANK = "INSERTED (is_blank_page=true) — blank/empty page added. Likely an intentional separator. Low severity."
CONTEXT_INSERTED = "INSERTED (is_blank_page=false) — new content page with no baseline counterpart."
CONTEXT_LINES = "LINE DIFF (line-by-line comparison):"
CONTEXT_SAME_TEXT = "TEXT DIFF: Content identical — pixel differences are visual/graphical noise"
CONTEXT_LISTS = [("bold_changed", "BOLD CHANGED: "), ("size_changed", "FONT SIZE CHANGED: "), ("list_shifted", "LIST ALIGNMENT SHIFTED: ")]
CONTEXT_FORMATTING, CONTEXT_GRAPHICS, CONTEXT_SIGNATURE = "FORMATTING: ", "GRAPHICS CHANGE: ", "[SIGNATURE CANDIDATE near '%s']"
CONTEXT_DOCUMENT, CONTEXT_METADATA, CONTEXT_FIELDS = "\nDOCUMENT-LEVEL CHANGES:", "METADATA CHANGES (document properties):", "FORM FIELD STRUCTURE CHANGES:"
CONTEXT_REMOVED, CONTEXT_ADDED, CONTEXT_TYPE = "  REMOVED FIELDS: ", "  ADDED FIELDS: ", "  FIELD TYPE CHANGED: "
CONTEXT_CHANGES, CONTEXT_WORDS, CONTEXT_TYPES, CONTEXT_LONG, CONTEXT_SHORT, CONTEXT_BLOCK = 20, 6, 5, 120, 80, 100

# Labels of page images in a request.
IMAGE_DELETED, IMAGE_INSERTED = "BASELINE page %s — DELETED (no match in current)", "CURRENT page %s — INSERTED (no match in baseline)"
IMAGE_MATCHED, IMAGE_PAGE = "BASELINE page %s matched to CURRENT page %s", "page %s"

# Accessibility findings: type to severity, criterion and text.
_LABEL = "1.3.1 Info and Relationships (Level A)"
ACCESSIBILITY = {
    "missing_label": ("high", _LABEL, "Form field '%s' has no accessible label or tooltip."),
    "missing_language": ("medium", "3.1.1 Language of Page (Level A)", "PDF document does not declare a language (lang attribute missing)."),
    "missing_title": ("medium", "2.4.2 Page Titled (Level A)", "PDF does not have a descriptive document title."),
    "unlabeled_signature": ("high", _LABEL, "Signature field '%s' lacks an accessible label."),
    "image_only_page": ("medium", "1.1.1 Non-text Content (Level A)", "Page %s appears to contain little or no text — may be an image-only page with no alt text."),
    "unexplained_required_indicator": ("low", "3.3.2 Labels or Instructions (Level A)", "Form uses asterisks (*) or 'required' labels but may not explain their meaning to all users."),
}

# Expressions for list markers, bold fonts, signature fields, required marks and what explains them.
LIST_MARKER = r"^(\([a-zA-Z0-9]\)|[a-zA-Z]\.|[0-9]+\.|\([ivxIVX]+\)|[ivxIVX]+\.|[•‣◦⁃∙\-–])$"
BOLD_FONT = "bold|heavy|black|,b|-bd|-b,|-b$"
SIGNATURE_FIELD = "(?i)sign|signature|authorized|approval"
REQUIRED_MARK, REQUIRED_TOLD = r"(?i)\*|required|mandatory", r"(?i)\*\s*(=|means?|denotes?|indicates?|required)"
