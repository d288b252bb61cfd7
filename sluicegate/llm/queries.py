"""The queries of this subpackage, and the SQL of those that SQL can express."""

from sluicegate.llm import decontaminate, jaccard_join, kn_lm, language_id, line_dedup, pii_bootstrap, quality_rules, toxicity, viterbi_pieces, warc_index

QUERIES = {
    "op1_warc_index": warc_index.op1_warc_index,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_pii": pii_bootstrap.op5_pii,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_language_id": language_id.op7_language_id,
    "op8_sentencepiece": viterbi_pieces.op8_sentencepiece,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_lm_scoring": kn_lm.op10_lm_scoring,
}

SQL = {
    "op1_warc_index": warc_index.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
}
