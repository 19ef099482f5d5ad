"""Relational operators of retrieval, graph analytics, evaluation and reporting."""
