"""Interval, evidence and text analytics expressed as PySpark jobs."""
