"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import embedding_dup, language_model, mixing, near_dup, neighbours, packing, pii, quality, token_files, toxicity

QUERIES = {
    "op1_attention_mil_quality": quality.op1_attention_mil_quality,
    "op2_conflict_best_fit": packing.op2_conflict_best_fit,
    "op3_minhash_near_dedup": near_dup.op3_minhash_near_dedup,
    "op4_bit_plane_tokens": token_files.op4_bit_plane_tokens,
    "op5_pfair_mixing": mixing.op5_pfair_mixing,
    "op6_elias_fano_lm": language_model.op6_elias_fano_lm,
    "op7_surrogate_pii": pii.op7_surrogate_pii,
    "op8_boosted_toxicity": toxicity.op8_boosted_toxicity,
    "op9_collision_counting_ann": neighbours.op9_collision_counting_ann,
    "op10_embedding_near_dedup": embedding_dup.op10_embedding_near_dedup,
}

SQL = {
    "op3_minhash_near_dedup": near_dup.SQL,
    "op5_pfair_mixing": mixing.SQL,
    "op9_collision_counting_ann": neighbours.SQL,
    "op10_embedding_near_dedup": embedding_dup.SQL,
}
