"""Operators for large text corpora: deduplication, filtering, scoring, mixing and sharding."""
