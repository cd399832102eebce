"""The registered queries of the subpackage and their SQL (a query without SQL is tested against brute force)."""

from __future__ import annotations

from quire.llm import (
    op1_ngram_jaccard,
    op2_byte_bpe,
    op3_decontamination,
    op4_id_planes,
    op5_line_dedup,
    op6_quality_rules,
    op7_crf_quality,
    op8_chat_format,
    op9_sharding,
    op10_secrets,
    op11_topk,
    op12_structure,
    op13_merkle,
)

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard.op1_ngram_jaccard,
    "op2_byte_bpe": op2_byte_bpe.op2_byte_bpe,
    "op3_decontamination": op3_decontamination.op3_decontamination,
    "op4_id_planes": op4_id_planes.op4_id_planes,
    "op5_line_dedup": op5_line_dedup.op5_line_dedup,
    "op6_quality_rules": op6_quality_rules.op6_quality_rules,
    "op7_crf_quality": op7_crf_quality.op7_crf_quality,
    "op8_chat_format": op8_chat_format.op8_chat_format,
    "op9_sharding": op9_sharding.op9_sharding,
    "op10_secrets": op10_secrets.op10_secrets,
    "op11_topk": op11_topk.op11_topk,
    "op12_structure": op12_structure.op12_structure,
    "op13_merkle": op13_merkle.op13_merkle,
}
SQL = {
    "op3_decontamination": op3_decontamination.SQL,
    "op6_quality_rules": op6_quality_rules.SQL,
    "op8_chat_format": op8_chat_format.SQL,
    "op9_sharding": op9_sharding.SQL,
    "op11_topk": op11_topk.SQL,
    "op12_structure": op12_structure.SQL,
    "op13_merkle": op13_merkle.SQL,
}
