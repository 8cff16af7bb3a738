"""Queries of this subpackage by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from cellweave.llm import byte_bpe, exact_dedup, jaccard_join, license_scan, lm_score, mixture, quality, suffix_dedup, toxicity, url_filter

_MODULES = (toxicity, jaccard_join, url_filter, license_scan, mixture, lm_score, byte_bpe, exact_dedup, suffix_dedup, quality)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
