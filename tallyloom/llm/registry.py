"""Queries and DuckDB SQL of this subpackage."""

from __future__ import annotations

from . import byte_bpe, chat_format, chunk_dedup, exact_dedup, filter_audit, jaccard_join, neighbours, packing, suffix_dedup, token_counts, token_files, toxicity, whitening

QUERIES = {
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op5_chunk_dedup": chunk_dedup.op5_chunk_dedup,
    "op3_neighbours": neighbours.op3_neighbours,
    "op2_packing": packing.op2_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op7_chat_format": chat_format.op7_chat_format,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_token_files": token_files.op12_token_files,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {"op7_chat_format": chat_format.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_filter_audit": filter_audit.SQL}
