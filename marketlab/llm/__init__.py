"""Operators for preparing training data: dedup, filtering, formatting, sharding, packing, scoring."""
