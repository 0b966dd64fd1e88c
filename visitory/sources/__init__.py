"""Readers and writers of hits."""
