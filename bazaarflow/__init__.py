"""Spark-native analytics over irregular market-price reports."""
