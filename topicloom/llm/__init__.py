"""Operators of a training-data pipeline: scoring, deduplication, tokens, archives, search."""
