"""The queries of the operators, over their whole tables, and their SQL."""

from __future__ import annotations

from . import (
    decontamination,
    divergence,
    jaccard_join,
    mixing,
    near_passages,
    prefix_forest,
    quality_rules,
    repeated_bytes,
    site_quality,
    surrogates,
    toxicity,
    training_order,
    vector_codes,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_site_quality": site_quality.query,
    "op3_training_order": training_order.query,
    "op4_surrogates": surrogates.query,
    "op5_toxicity": toxicity.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_source_mixing": mixing.query,
    "op8_near_passages": near_passages.query,
    "op9_benchmark_decontamination": decontamination.query,
    "op10_repeated_bytes": repeated_bytes.query,
    "op11_source_divergence": divergence.query,
    "op12_vector_codes": vector_codes.query,
    "op13_prefix_forest": prefix_forest.query,
}

ORACLES = {
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op9_benchmark_decontamination": decontamination.ORACLE,
    "op10_repeated_bytes": repeated_bytes.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
