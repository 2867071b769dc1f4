"""Spark-native analytics for irregular sensor series and event catalogs."""
