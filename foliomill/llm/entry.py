"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, exact_dedup, hnsw_dedup, huffman_ids, langid, packing, simhash_dedup, token_counts, toxicity, url_trust


def queries() -> dict:
    return {
        "op1_hnsw_dedup": hnsw_dedup.op1_hnsw_dedup,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_url_trust": url_trust.op5_url_trust,
        "op6_language_id": langid.op6_language_id,
        "op7_bpe_codec": bpe.op7_bpe_codec,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
        "op10_huffman_ids": huffman_ids.op10_huffman_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.ORACLE_SQL}
