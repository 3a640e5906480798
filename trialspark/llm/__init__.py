"""Operators that prepare text corpora for training: deduplication, cleaning, filtering, mixing, sharding."""
