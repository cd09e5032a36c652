"""Spark-native analytics over on-chain lending events."""
