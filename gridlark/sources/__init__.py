"""Readers and writers of the text formats of the domain."""
