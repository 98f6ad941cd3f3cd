"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from labelscope.llm import chat_format, decontaminate, embedding_dedup, html_text, licenses, mixing, near_dup, packing, quality, token_counts, toxicity, turn_repair

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.op1_embedding_near_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_minhash_near_dedup": near_dup.op3_minhash_near_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_mixing": mixing.op8_mixing,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_packing": packing.op12_packing,
}

#: Queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE = {
    "op1_embedding_near_dedup": embedding_dedup.OP1_SQL,
    "op3_minhash_near_dedup": near_dup.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_chat_format": chat_format.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_turn_repair": turn_repair.OP11_SQL,
}
