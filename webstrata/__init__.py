"""Spark-native engine for web-archive capture indexes."""
