"""Spark-native analytics over workout and wearable-health history."""

__version__ = "0.1.0"
