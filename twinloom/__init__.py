"""Spark-native synthetic twins of tabular data: profile, generate, evaluate, certify."""

__version__ = "0.1.0"
