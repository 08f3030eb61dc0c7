"""Readers and writers of name lists and side tables."""
