"""Operators of a training-data pipeline: scoring, scanning, de-duplication, search and encoding."""
