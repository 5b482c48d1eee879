"""Spark-native analytics over interacting pairs: sparse counts, contact graphs and their communities."""

__version__ = "0.1.0"
