"""Relational and domain operators: DataFrame in, DataFrame out."""
