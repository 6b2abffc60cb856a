"""Corpus preparation and completion scoring as Spark DataFrame jobs."""
