"""Operators for large text corpora: cleaning, de-duplication, mixing, packing."""
