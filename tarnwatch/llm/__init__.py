"""Operators for training-data corpora: filtering, deduplication, packing, archives."""
