"""Operators of a training-data pipeline: quality, deduplication, formatting, mixing, output."""
