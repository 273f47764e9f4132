"""Operators for training corpora: deduplication, sharding, tokens, quality, language and packing."""
