"""Registered queries of the operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from anbar.llm import (
    bpe,
    chat,
    embedding_dedup,
    html_text,
    lexical_search,
    line_dedup,
    lm_score,
    minhash_dedup,
    mixing,
    packing,
    periodic_runs,
    quality,
    secrets,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_embedding_near_dedup": embedding_dedup.op2_embedding_near_dedup,
    "op3_packing": packing.op3_packing,
    "op4_chat": chat.op4_chat,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_minhash_near_dedup": minhash_dedup.op8_minhash_near_dedup,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_secrets": secrets.op10_secrets,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_bpe": bpe.op12_bpe,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_embedding_near_dedup": embedding_dedup.SQL,
    "op4_chat": chat.SQL,
    "op11_lexical_search": lexical_search.SQL,
}
