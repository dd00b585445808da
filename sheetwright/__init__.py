"""Spark-native analytics for page-level document metadata."""
