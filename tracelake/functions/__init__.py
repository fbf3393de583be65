"""Columns: predicates, texts, identities, content blocks."""
