"""Retort: Spark-native analytics for molecular tables and corpora."""
