"""Readers and writers of the text, SDF, JSON and CSV forms."""
