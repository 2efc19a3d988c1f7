"""Spark-native document, vector and retrieval engine."""

__version__ = "0.1.0"
