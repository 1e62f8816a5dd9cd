"""Operators for preparing text, page and media corpora at scale."""
