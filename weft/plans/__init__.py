"""The query catalogue with its SQL."""
