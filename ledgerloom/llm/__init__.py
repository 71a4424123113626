"""Operators for large text corpora: deduplication, tokenising, packing, filtering, scoring."""
