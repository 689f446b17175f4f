"""Spark-native ranked retrieval, graph and trajectory analytics."""

__version__ = "0.1.0"
