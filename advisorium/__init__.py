"""Spark-native analytics for security-advisory data and training corpora."""
