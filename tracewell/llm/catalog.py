"""The registered training-data queries and the SQL that states them, where SQL can."""

from __future__ import annotations

from . import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    lm_scoring,
    packing,
    sharding,
    token_files,
    toxicity,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_token_files": token_files.op2_token_files,
    "op3_hierarchical_packing": packing.op3_hierarchical_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_winnowing_decontamination": decontaminate.op5_winnowing_decontamination,
    "op6_cross_entropy_difference": lm_scoring.op6_cross_entropy_difference,
    "op7_line_chunks": line_dedup.op7_line_chunks,
    "op8_multi_order_jaccard": jaccard_join.op8_multi_order_jaccard,
    "op9_rendezvous_sharding": sharding.op9_rendezvous_sharding,
    "op10_toxicity_chain": toxicity.op10_toxicity_chain,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_winnowing_decontamination": decontaminate.OP5_SQL,
    "op8_multi_order_jaccard": jaccard_join.OP8_SQL,
}
