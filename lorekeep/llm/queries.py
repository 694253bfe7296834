"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from lorekeep.llm import byte_bpe, decontaminate, html_extract, line_dedup, ngram_jaccard, ngram_lm, packing, quality_rules, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_decontaminate": decontaminate.query,
    "op3_ngram_jaccard": ngram_jaccard.query,
    "op4_quality_rules": quality_rules.query,
    "op5_packing": packing.query,
    "op6_url_filter": url_filter.query,
    "op7_ngram_lm": ngram_lm.query,
    "op8_toxicity": toxicity.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_html_extract": html_extract.query,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_url_filter": url_filter.SQL,
}
