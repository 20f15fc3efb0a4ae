"""Column expressions and exact rank statistics."""
