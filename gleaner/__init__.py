"""Spark-native engine that turns web pages and documents into a searchable, attributed corpus."""

__version__ = "0.1.0"
