"""The queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from . import bpe, exact_dedup, license_scan, mixing, near_dedup, paragraph_dedup, quality_rules, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_block_naming": (exact_dedup.op1, exact_dedup.OP1_SQL),
    "op2_token_files": (token_files.op2, None),
    "op3_token_counts": (token_counts.op3, None),
    "op4_bpe_segment_tree": (bpe.op4, None),
    "op5_license_classifier": (license_scan.op5, None),
    "op6_column_suffix_sort": (suffix_dedup.op6, None),
    "op7_paragraph_minhash": (paragraph_dedup.op7, None),
    "op8_order_minhash": (near_dedup.op8, None),
    "op9_mcd_outliers": (quality_rules.op9, None),
    "op10_soft_mixing": (mixing.op10, None),
}
