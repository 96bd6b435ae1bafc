"""Spark-native analytics over industrial-automation source projects."""
