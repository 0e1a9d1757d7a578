"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from strataquill.llm import chat_format, decontamination, exact_dedup, lm_score, near_dedup, packing, quality, secret_scan, sharding, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_spaced_seed_decontamination": decontamination.op3_spaced_seed_decontamination,
    "op4_hypergeometric_sharding": sharding.op4_hypergeometric_sharding,
    "op5_minhash_lsh_forest": near_dedup.op5_minhash_lsh_forest,
    "op6_chat_template": chat_format.op6_chat_template,
    "op7_masked_pseudo_likelihood": lm_score.op7_masked_pseudo_likelihood,
    "op8_weak_label_quality": quality.op8_weak_label_quality,
    "op9_forest_secret_scan": secret_scan.op9_forest_secret_scan,
    "op10_nb_scaled_toxicity": toxicity.op10_nb_scaled_toxicity,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_spaced_seed_decontamination": decontamination.ORACLE,
    "op5_minhash_lsh_forest": near_dedup.ORACLE,
    "op6_chat_template": chat_format.ORACLE,
}
