"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from tallyloom.llm import chat, decontam, fingerprints, licences, mixing, neardup, quality, secrets, tokens, urls

QUERIES = {
    "op1_importance_resampling": quality.query,
    "op10_bloom_cascade": urls.query,
    "op2_secret_ownership": secrets.query,
    "op3_licence_classifier": licences.query,
    "op4_cgk_decontamination": decontam.query,
    "op5_mix_sources": mixing.query,
    "op6_bagminhash_neardup": neardup.query,
    "op7_merkle_fingerprints": fingerprints.query,
    "op8_chat_collapse": chat.query,
    "op9_token_counts": tokens.query,
}

ORACLES = {
    "op2_secret_ownership": secrets.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op7_merkle_fingerprints": fingerprints.ORACLE,
    "op8_chat_collapse": chat.ORACLE,
    "op10_bloom_cascade": urls.ORACLE,
}
