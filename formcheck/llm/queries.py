"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from formcheck.llm.op1_bpe import op1_bpe
from formcheck.llm.op2_toxicity import op2_toxicity
from formcheck.llm.op3_exact_dedup import OP3_SQL, op3_exact_dedup
from formcheck.llm.op4_hilbert_ann import op4_hilbert_ann
from formcheck.llm.op5_minhash import OP5_SQL, op5_minhash
from formcheck.llm.op6_packing import op6_packing
from formcheck.llm.op7_token_counts import op7_token_counts
from formcheck.llm.op8_warc import OP8_SQL, op8_warc
from formcheck.llm.op9_substring_dedup import op9_substring_dedup
from formcheck.llm.op10_url_filter import OP10_SQL, op10_url_filter
from formcheck.llm.op11_suffix_array import op11_suffix_array
from formcheck.llm.op12_alignment import op12_alignment
from formcheck.llm.op13_filter_audit import OP13_SQL, op13_filter_audit

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_toxicity, op3_exact_dedup, op4_hilbert_ann, op5_minhash, op6_packing, op7_token_counts, op8_warc, op9_substring_dedup, op10_url_filter,
        op11_suffix_array, op12_alignment, op13_filter_audit,
    )
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op5_minhash": OP5_SQL, "op8_warc": OP8_SQL, "op10_url_filter": OP10_SQL, "op13_filter_audit": OP13_SQL}
