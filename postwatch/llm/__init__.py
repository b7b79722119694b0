"""Operators for building training data: deduplication, fingerprints, filters, tokenizing, archives and language models."""
