"""Operators for preparing training corpora: fingerprints, filters, sharding, mixing, tokens."""
