"""The queries of this package and the SQL that their results are held against, by name."""

from __future__ import annotations

from . import bpe, chat, decontaminate, jaccard_join, language_id, quality_rank, quality_rules, sharding, token_counts, toxicity

QUERIES = {
    "op1_ngram_jaccard": jaccard_join.op1_ngram_jaccard,
    "op2_pairwise_quality": quality_rank.op2_pairwise_quality,
    "op3_pigeonhole_decontamination": decontaminate.op3_pigeonhole_decontamination,
    "op4_pair_index_bpe": bpe.op4_pair_index_bpe,
    "op5_distribution_divergence": quality_rules.op5_distribution_divergence,
    "op6_marginal_unigrams": language_id.op6_marginal_unigrams,
    "op7_digest_cache_counts": token_counts.op7_digest_cache_counts,
    "op8_hash_tree_sharding": sharding.op8_hash_tree_sharding,
    "op9_convolutional_toxicity": toxicity.op9_convolutional_toxicity,
    "op10_typed_parts_chat": chat.op10_typed_parts_chat,
}
ORACLES = {
    "op8_hash_tree_sharding": sharding.oracle_sql(),
    "op10_typed_parts_chat": chat.ORACLE,
}
