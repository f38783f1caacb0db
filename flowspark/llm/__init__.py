"""Operators for building training corpora: search, scoring, mixing, dedup, sharding, packing, PII, quality."""
