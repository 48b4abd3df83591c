"""Operators for preparing training data: dedup, sharding, mixing, packing, filters, extraction."""
