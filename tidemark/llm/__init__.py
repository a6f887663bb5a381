"""Operators for preparing text corpora: deduplication, filtering, scoring and mixing."""
