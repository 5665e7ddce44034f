"""The queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from noticeworks.llm import bpe, filter_audit, fingerprints, hard_negatives, near_dups, packing, passages, pii, quality, token_counts, token_files, vectors, warc

MODULES = (pii, packing, near_dups, vectors, bpe, quality, fingerprints, warc, token_counts, passages, token_files, hard_negatives, filter_audit)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
