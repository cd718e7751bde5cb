"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from patchweave.llm import bpe, chat_format, conversation_repair, decontaminate, language_id, lexical_search, near_dedup, pii, quality_rules, sharding, token_counts, url_filter, vector_search

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_pii": pii.op3_pii,
    "op4_sharding": sharding.op4_sharding,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_language_id": language_id.op7_language_id,
    "op8_bpe": bpe.op8_bpe,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_vector_search": vector_search.op13_vector_search,
}

ORACLE_SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_chat_format": chat_format.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_lexical_search": lexical_search.SQL,
    "op13_vector_search": vector_search.SQL,
}
