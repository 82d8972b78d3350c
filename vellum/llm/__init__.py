"""Operators for text corpora used in model training. Nothing outside this package imports it."""
