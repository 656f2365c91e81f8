"""Operators of a training-data pipeline: quality, packing, near-duplicates, tokens, mixing, scoring, PII, toxicity, vectors."""
