"""Spark-native analytics for market tape and broker-flow data."""
