"""Spark-native formula discovery and curve analytics."""

__version__ = "0.1.0"
