"""Spark-native analytics over dependency graphs, execution logs and content."""
