"""Operators for large text corpora: duplicates, tokens, mixing, packing, scoring, extraction, search."""
