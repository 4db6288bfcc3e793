"""Column builders: vectors, chemistry texts, formats."""
