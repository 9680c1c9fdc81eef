"""Spark-native sequence alignment and record processing."""

__version__ = "0.1.0"
