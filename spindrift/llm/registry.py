"""Queries and SQL of the training-data operators, for the repository's entry file."""

from __future__ import annotations

from spindrift.llm import ann, bm25, bpe, chat, mixing, ngram_join, quality, secret_scan, toxicity, warc

_MODULES = (toxicity, bm25, ngram_join, secret_scan, chat, ann, quality, bpe, mixing, warc)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
