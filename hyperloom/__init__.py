"""Spark-first analytics for hyperspectral image cubes."""
