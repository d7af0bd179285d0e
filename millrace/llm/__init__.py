"""Operators for building training data: near-duplicates, decontamination, filters, tokens.

Nothing outside this package imports it; `millrace.llm.registry` lists its queries and SQL.
"""
