"""Corpus operators for training data: packing, counting, deduplication, filtering, mixing, sharding."""
