"""Column expressions made of built-in functions."""
