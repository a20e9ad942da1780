"""The registered queries of this package and their SQL."""

from __future__ import annotations

from strandworks.llm import (
    byte_bpe,
    decontaminate,
    filter_audit,
    html_extract,
    line_dedup,
    minhash,
    mixing,
    pfp_dedup,
    quality_classifier,
    quality_rules,
    ranked_search,
    sharding,
    token_counts,
)

QUERIES = {
    "op1_pareto_mixing": mixing.op1_pareto_mixing,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_suffix_decontamination": decontaminate.op4_suffix_decontamination,
    "op5_pfp_substrings": pfp_dedup.op5_pfp_substrings,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_line_edit_join": line_dedup.op7_line_edit_join,
    "op8_minhash_dedup": minhash.op8_minhash_dedup,
    "op9_extendible_sharding": sharding.op9_extendible_sharding,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES = {
    "op1_pareto_mixing": mixing.OP1_SQL,
    "op4_suffix_decontamination": decontaminate.OP4_SQL,
    "op5_pfp_substrings": pfp_dedup.OP5_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_line_edit_join": line_dedup.OP7_SQL,
    "op8_minhash_dedup": minhash.OP8_SQL,
    "op9_extendible_sharding": sharding.OP9_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
