"""Registry of the corpus queries."""

from __future__ import annotations

from measura.llm import (
    op1_language_id, op2_secrets, op3_decontamination, op4_nearest, op5_mixing, op6_ngram_join, op7_token_files, op8_token_counts, op9_sharding, op10_toxicity,
    op11_quality, op12_clusters, op13_conversations,
)

QUERIES = {
    "op1_language_id": op1_language_id.query,
    "op2_secrets": op2_secrets.query,
    "op3_decontamination": op3_decontamination.query,
    "op4_nearest": op4_nearest.query,
    "op5_mixing": op5_mixing.query,
    "op6_ngram_join": op6_ngram_join.query,
    "op7_token_files": op7_token_files.query,
    "op8_token_counts": op8_token_counts.query,
    "op9_sharding": op9_sharding.query,
    "op10_toxicity": op10_toxicity.query,
    "op11_quality": op11_quality.query,
    "op12_clusters": op12_clusters.query,
    "op13_conversations": op13_conversations.query,
}

#: Queries with a SQL form; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_secrets": op2_secrets.ORACLE,
    "op3_decontamination": op3_decontamination.ORACLE,
    "op5_mixing": op5_mixing.ORACLE,
    "op6_ngram_join": op6_ngram_join.ORACLE,
    "op12_clusters": op12_clusters.ORACLE,
}
