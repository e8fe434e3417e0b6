"""Spark-native tables out of messy files: find, type, store, search and query them."""

__version__ = "0.1.0"
