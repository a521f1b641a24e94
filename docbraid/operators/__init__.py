"""Relational operators: DataFrame in, DataFrame out, keyed by (doc_id, idx)."""
