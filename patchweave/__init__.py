"""Spark-native change-review analytics: diffs, symbols, recall, packing, findings."""
