"""Operators for preparing training corpora: near and exact deduplication, packing, toxicity, token counts,
URL filtering, language identification, byte-pair coding and token-id files.  Nothing outside this package
imports it."""
