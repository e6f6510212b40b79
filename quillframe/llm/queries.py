"""Queries of this package and their SQL, for the driver's entry."""

from quillframe.llm import (
    op01_quality_classifier,
    op02_quality_rules,
    op03_license_scan,
    op04_html_extraction,
    op05_url_filters,
    op06_lm_scoring,
    op07_ngram_jaccard_join,
    op08_media_columns,
    op09_packing,
    op10_mixing,
    op11_filter_audit,
    op12_merkle_manifest,
    op13_minhash_dedup,
)

QUERIES = {
    "op1_quality_classifier": op01_quality_classifier.query,
    "op2_quality_rules": op02_quality_rules.query,
    "op3_license_scan": op03_license_scan.query,
    "op4_html_extraction": op04_html_extraction.query,
    "op5_url_filters": op05_url_filters.query,
    "op6_lm_scoring": op06_lm_scoring.query,
    "op7_ngram_jaccard_join": op07_ngram_jaccard_join.query,
    "op8_media_columns": op08_media_columns.query,
    "op9_packing": op09_packing.query,
    "op10_mixing": op10_mixing.query,
    "op11_filter_audit": op11_filter_audit.query,
    "op12_merkle_manifest": op12_merkle_manifest.query,
    "op13_minhash_dedup": op13_minhash_dedup.query,
}
ORACLES = {
    "op7_ngram_jaccard_join": op07_ngram_jaccard_join.ORACLE,
    "op5_url_filters": op05_url_filters.ORACLE,
    "op9_packing": op09_packing.ORACLE,
    "op10_mixing": op10_mixing.ORACLE,
    "op11_filter_audit": op11_filter_audit.ORACLE,
    "op12_merkle_manifest": op12_merkle_manifest.ORACLE,
    "op13_minhash_dedup": op13_minhash_dedup.ORACLE,
}
