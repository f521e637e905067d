"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from vecloom.llm import (
    decontaminate,
    divergence,
    language_model,
    line_dedup,
    ngram_join,
    packing,
    preference,
    prefix_trie,
    quality_rules,
    secret_scan,
    sharding,
    token_files,
    toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_preference_format": preference.op2_preference_format,
    "op3_lm_scoring": language_model.op3_lm_scoring,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_sharding": sharding.op5_sharding,
    "op6_packing": packing.op6_packing,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_token_files": token_files.op10_token_files,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op2_preference_format": preference.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_secret_scan": secret_scan.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
