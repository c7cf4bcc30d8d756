"""Spark-native span detection, review and evaluation for text at scale."""

__version__ = "0.1.0"
