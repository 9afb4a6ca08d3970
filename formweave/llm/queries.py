"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from formweave.llm import q_bpe, q_collocations, q_decontaminate, q_divergence, q_jaccard, q_licenses, q_mixture, q_quality, q_secrets, q_sharding, q_simhash, q_substring, q_urls

_PARTS = [q_bpe, q_collocations, q_decontaminate, q_divergence, q_jaccard, q_licenses, q_mixture, q_quality, q_secrets, q_sharding, q_simhash, q_substring, q_urls]
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _PARTS for k, v in m.ORACLE.items()}
