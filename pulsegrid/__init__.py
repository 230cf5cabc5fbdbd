"""Spark-first analytics for time-lapse recordings of beating cells."""
