"""Queries of the operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from . import chat, classifier, fingerprints, html_text, mixing, near_dedup, ngram_lm, packing, quality_rules, urls

QUERIES = {f.__name__: f for f in (near_dedup.op1_near_dedup, html_text.op2_html_text, packing.op3_packing, ngram_lm.op4_katz_lm, fingerprints.op5_fingerprints, quality_rules.op6_quality_rules, chat.op7_chat_format, urls.op8_url_filter, mixing.op9_source_mix, classifier.op10_quality_classifier)}
ORACLES = {"op7_chat_format": chat.ORACLE, "op8_url_filter": urls.ORACLE}
