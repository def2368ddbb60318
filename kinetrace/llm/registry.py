"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from kinetrace.llm import exact_dedup, fill_middle, hard_negatives, hash_forest, html_extract, language_id, line_dedup, minhash, ngram_model, packing, pieces, syncmers, token_files

MODULES = (language_id, html_extract, packing, token_files, line_dedup, minhash, syncmers, pieces, ngram_model, exact_dedup, fill_middle, hard_negatives, hash_forest)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
