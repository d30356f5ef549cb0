"""Operators for large training-data corpora. Nothing outside imports this."""
