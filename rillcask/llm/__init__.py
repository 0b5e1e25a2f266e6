"""Operators for training data: deduplication, search, packing, scoring, filters, mixing."""
