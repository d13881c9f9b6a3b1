"""Spark-native analytics over short strings: k-mers, similarity joins, empirical ranks, set design."""
