"""Operators for building large text corpora: archives, deduplication, search, extraction, labelling, mixing, packing."""
