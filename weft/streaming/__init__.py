"""Streaming forms of the table build."""
