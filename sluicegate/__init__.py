"""Sluicegate: a Spark-native engine for streaming data quality."""
