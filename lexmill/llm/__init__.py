"""Operators of a training-data pipeline: cleaning, deduplication, search, tokens and packing."""
