"""Spark-native mobility privacy engine: trajectories in, anonymized trajectories, heat maps and measures out."""

__version__ = "0.1.0"
