"""Spark-native analytics engine for mined-history and measurement data."""
