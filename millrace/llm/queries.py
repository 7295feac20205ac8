"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from millrace.llm import chat, ctw, exact_dedup, importance, language_id, mix, pii, simhash, sp_codec, topk

QUERIES = {
    "op1_topk": topk.query,
    "op2_mix": mix.query,
    "op3_ctw": ctw.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_language_id": language_id.query,
    "op6_sentencepiece": sp_codec.query,
    "op7_pii": pii.query,
    "op8_chat": chat.query,
    "op9_simhash": simhash.query,
    "op10_importance": importance.query,
}

ORACLE_SQL = {
    "op1_topk": topk.SQL,
    "op2_mix": mix.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op8_chat": chat.SQL,
}
