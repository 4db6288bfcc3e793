"""Operators that prepare text for language-model training; nothing else in ``weft`` imports them."""
