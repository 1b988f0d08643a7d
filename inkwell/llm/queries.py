"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from inkwell.llm import (
    op1_quality, op2_mixing, op3_html, op4_toxicity, op5_licenses, op6_decontaminate, op7_minhash, op8_warc, op9_pii, op10_exact_dedup,
    op11_conversation_repair, op12_language_id, op13_spelling_variants,
)

QUERIES = {
    "op1_quality": op1_quality.query,
    "op2_mixing": op2_mixing.query,
    "op3_html_extraction": op3_html.query,
    "op4_toxicity": op4_toxicity.query,
    "op5_licenses": op5_licenses.query,
    "op6_decontaminate": op6_decontaminate.query,
    "op7_minhash_near_dedup": op7_minhash.query,
    "op8_warc": op8_warc.query,
    "op9_pii": op9_pii.query,
    "op10_exact_dedup": op10_exact_dedup.query,
    "op11_conversation_repair": op11_conversation_repair.query,
    "op12_language_id": op12_language_id.query,
    "op13_spelling_variants": op13_spelling_variants.query,
}
ORACLES = {
    "op8_warc": op8_warc.SQL,
    "op10_exact_dedup": op10_exact_dedup.SQL,
    "op11_conversation_repair": op11_conversation_repair.SQL,
    "op13_spelling_variants": op13_spelling_variants.SQL,
}
