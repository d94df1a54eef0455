"""Spark-native analytics over ordered event and interval series."""
