"""Readers of corpora and gold sets; reading and writing of models."""
