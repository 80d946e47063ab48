"""Distributed building blocks: salted attach, row numbering, similarity join,
leader clustering, grid reduction, key-set operations."""
