"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from churnlake.llm import (
    byte_bpe, elias_fano, filter_audit, hidden_markov, line_dedup, ngram_join, packing, phrases, projection_forest, quality_rules,
    sharding, tag_paths, toxicity,
)

QUERIES = {
    "op1_extendible_sharding": sharding.op1_extendible_sharding,
    "op2_config_lp_packing": packing.op2_config_lp_packing,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_projection_forest": projection_forest.op4_projection_forest,
    "op5_hidden_markov": hidden_markov.op5_hidden_markov,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_tag_paths": tag_paths.op9_tag_paths,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_elias_fano_ids": elias_fano.op11_elias_fano_ids,
    "op12_toivonen_phrases": phrases.op12_toivonen_phrases,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op1_extendible_sharding": sharding.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op12_toivonen_phrases": phrases.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
