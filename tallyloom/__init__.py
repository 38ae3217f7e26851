"""Spark-native sparse-retrieval analytics."""
