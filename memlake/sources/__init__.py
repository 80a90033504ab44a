"""Readers and writers for archives and tables."""
