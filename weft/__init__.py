"""Spark-native similarity, matching and result analytics."""
