"""Spark-native difference imaging and per-pixel analytics."""

__version__ = "0.1.0"
