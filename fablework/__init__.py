"""Spark-native preparation and analysis of instruction-annotated text corpora."""

__version__ = "0.1.0"
