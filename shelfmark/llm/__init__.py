"""Operators of a training-data pipeline: extraction, scoring, deduplication, mixing, formatting, tokens, archives."""
