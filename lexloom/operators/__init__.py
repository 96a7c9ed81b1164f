"""Operators on corpora, examples and embedding tables."""
