"""Spark-native document privacy engine and training-data operators."""
