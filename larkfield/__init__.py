"""Larkfield: Spark-native table jobs for commerce, learning and content data."""
