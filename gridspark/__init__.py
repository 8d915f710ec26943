"""Spark-first analytics for gridded and point environmental series."""
