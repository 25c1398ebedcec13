"""Spark-native analytics over attributed graphs, feature tables and optimisation models."""
