"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from folioscope.llm import collocations, decontaminate, exact_dedup, language_id, lm_score, mixing, multi_index, secrets, simhash, substring_dedup, token_store, url_filter, vector_codes

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_mix_sources": mixing.op2,
    "op3_token_codes": token_store.op3,
    "op4_simhash": simhash.op4,
    "op5_url_filter": url_filter.op5,
    "op6_lm_score": lm_score.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_language_id": language_id.op9,
    "op10_secret_scan": secrets.op10,
    "op11_multi_index": multi_index.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_collocations": collocations.op13,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_multi_index": multi_index.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
