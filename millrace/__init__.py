"""Millrace: a PySpark-native engine for syndicated content, text search and training-data work."""

VERSION = "1.1.0"
