"""Spark-native preparation and evaluation of chat and multiple-choice corpora."""

__version__ = "0.1.0"
