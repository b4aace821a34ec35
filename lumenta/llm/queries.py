"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from . import chat_format, decontaminate, license_scan, line_dedup, ngram_jaccard, private_data, quality_rules, source_mixing, suffix_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_chat_format": chat_format.query,
    "op3_license_scan": license_scan.query,
    "op4_quality_rules": quality_rules.query,
    "op5_private_data": private_data.query,
    "op6_decontaminate": decontaminate.query,
    "op7_line_dedup": line_dedup.query,
    "op8_ngram_jaccard": ngram_jaccard.query,
    "op9_source_mixing": source_mixing.query,
    "op10_suffix_dedup": suffix_dedup.query,
}
ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_ngram_jaccard": ngram_jaccard.ORACLE,
    "op9_source_mixing": source_mixing.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
}
