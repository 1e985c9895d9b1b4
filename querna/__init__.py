"""Spark-native search analytics."""
