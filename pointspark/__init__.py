"""Spark-native analytics for coloured point clouds."""
