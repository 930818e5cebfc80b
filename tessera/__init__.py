"""Spark-native memory-graph analytics engine."""
