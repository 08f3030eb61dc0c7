"""Operators for preparing training data: one module each, plus shared helpers."""
