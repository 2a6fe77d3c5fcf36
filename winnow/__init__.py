"""Winnow: a Spark-native engine that builds, cleans, scores, mixes and evaluates instruction data."""
