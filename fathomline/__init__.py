"""Spark-first analytics for weekly panels of grouped price series."""
