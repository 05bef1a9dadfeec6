"""Column expressions: labels, time keys, numbers."""
