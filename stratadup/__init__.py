"""Spark-native redundancy analytics: chunk streams, similarity routing, deduplication reports."""
