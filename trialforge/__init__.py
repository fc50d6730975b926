"""Spark-native analytics for controlled, repeated-measures experiments."""

__version__ = "0.1.0"
