"""Spark-native analytics over code and text findings."""
