"""The queries of this subpackage and their SQL, by name."""

from timeloom.llm import chat, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, url_filters

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_language_id": language_id.op6_language_id,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_decontamination": decontamination.op10_decontamination,
}
SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
}
