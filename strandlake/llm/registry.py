"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, classlm, decontaminate, jaccard, packing, pii, quality, suffixdedup, tokenstore, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_pii": pii.op3_pii,
    "op4_suffix_dedup": suffixdedup.op4_suffix_dedup,
    "op5_token_store": tokenstore.op5_token_store,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_lm_scoring": classlm.op8_lm_scoring,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_decontamination": decontaminate.op10_decontamination,
}
ORACLE: dict[str, str] = {"op9_jaccard_join": jaccard.OP9_SQL, "op10_decontamination": decontaminate.OP10_SQL}
