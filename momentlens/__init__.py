"""Spark-native moment analytics: signals, intervals, vectors, manifests and timelines as DataFrames."""
