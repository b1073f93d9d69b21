"""A Spark-native engine for log and event queries in a compact one-line language."""
