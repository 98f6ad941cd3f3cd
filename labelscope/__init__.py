"""Spark-native evaluation of predictions on windowed sensor and event data under partial labels."""
