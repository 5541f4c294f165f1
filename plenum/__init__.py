"""Spark-native discourse and governance analytics."""
