"""The queries of this package and the SQL that DuckDB runs for them."""

from __future__ import annotations

from . import binary_ids, decontamination, html_extraction, pii, quality, sampled_pieces, secrets, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_personal_data": pii.op2_personal_data,
    "op3_sampled_pieces": sampled_pieces.op3_sampled_pieces,
    "op4_token_id_files": binary_ids.op4_token_id_files,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op8_benchmark_decontamination": decontamination.OP8_SQL,
}
