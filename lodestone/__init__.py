"""Spark-native knowledge-store analytics."""
