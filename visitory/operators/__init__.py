"""Relational operators: visits, filters, metrics, lookups, query shapes."""
