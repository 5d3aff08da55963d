"""Scalar and statistical functions as Columns."""
