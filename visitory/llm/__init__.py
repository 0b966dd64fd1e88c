"""Operators for large text, page and vector tables used to prepare training data."""
