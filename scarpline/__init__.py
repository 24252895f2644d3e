"""Spark-native feature analytics for tables of dated, located ground-stability events."""

__version__ = "0.1.0"
