"""Operators for building training corpora: filters, deduplication, fingerprints, tokens, shards."""
