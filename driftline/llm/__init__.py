"""Operators for large text and embedding corpora: deduplication, scoring, sharding, mixing and packing."""
