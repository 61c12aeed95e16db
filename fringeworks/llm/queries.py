"""The queries of this package, by name, and their SQL where SQL can express them."""

from . import op01_line_dedup, op02_license_scan, op03_ngram_jaccard, op04_topk_cover_tree, op05_quality_rules, op06_suffix_dedup, op07_html_text, op08_packing, op09_byte_bpe, op10_quality_crf, op11_merkle_manifest, op12_winnowing, op13_vector_codes

QUERIES = {
    "op1_line_dedup": op01_line_dedup.query,
    "op2_license_scan": op02_license_scan.query,
    "op3_ngram_jaccard": op03_ngram_jaccard.query,
    "op4_topk_cover_tree": op04_topk_cover_tree.query,
    "op5_quality_rules": op05_quality_rules.query,
    "op6_suffix_dedup": op06_suffix_dedup.query,
    "op7_html_text": op07_html_text.query,
    "op8_packing": op08_packing.query,
    "op9_byte_bpe": op09_byte_bpe.query,
    "op10_quality_crf": op10_quality_crf.query,
    "op11_merkle_manifest": op11_merkle_manifest.query,
    "op12_winnowing": op12_winnowing.query,
    "op13_vector_codes": op13_vector_codes.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": op01_line_dedup.SQL,
    "op4_topk_cover_tree": op04_topk_cover_tree.SQL,
    "op11_merkle_manifest": op11_merkle_manifest.SQL,
    "op13_vector_codes": op13_vector_codes.SQL,
}
