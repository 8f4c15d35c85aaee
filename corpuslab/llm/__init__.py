"""Operators of a training-data pipeline: quality, deduplication, mixing, tokens, pages, archives."""
