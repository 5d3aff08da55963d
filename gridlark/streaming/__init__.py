"""Structured Streaming faces of the positional operators."""
