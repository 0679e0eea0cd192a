"""Tidemark: a Spark-native point-in-time analytics library."""
