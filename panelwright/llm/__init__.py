"""Operators for large text and vector corpora; nothing else in the package imports them."""
