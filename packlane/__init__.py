"""Spark-first analytics over ZIP-based document packages."""
