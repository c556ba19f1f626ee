"""Spark-native profiling of time series held as one long table of points."""
