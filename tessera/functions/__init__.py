"""Column expressions, scalar functions and Arrow batch helpers."""
