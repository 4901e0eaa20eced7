"""Spark-native engine for grounded question-answering data."""
