"""Spark-native analytics over append-only usage logs, with operators for training-data pipelines."""
