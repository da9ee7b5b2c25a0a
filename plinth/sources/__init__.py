"""Typed tables from untyped cells, and what can be learned about tables."""
