"""The queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from quillstone.llm import byte_bpe, chat_format, embedding_dedup, language_id, packing, quality_rules, simhash, sort_means, spelling, substring_dedup, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_language_id": language_id.op6_language_id,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_token_files": token_files.op11_token_files,
    "op12_spelling": spelling.op12_spelling,
    "op13_sort_means": sort_means.op13_sort_means,
}
ORACLE_SQL = {"op2_quality_rules": quality_rules.ORACLE_SQL, "op13_sort_means": sort_means.ORACLE_SQL}
