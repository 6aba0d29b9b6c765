"""Registered queries, by family."""

from formcheck.plans import check_queries, compare_queries, evidence_queries, findings_queries, report_queries, review_queries, stream_queries  # noqa: F401
