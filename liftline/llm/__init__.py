"""Operators for training-data pipelines: deduplication, scoring, mixing, encoding."""
