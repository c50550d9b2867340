"""Operators for training corpora: filters, duplicates, tokens, archives and packing."""
