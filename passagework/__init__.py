"""Spark-native preparation of text collections for retrieval."""
