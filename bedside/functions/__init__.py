"""Column expressions: time arithmetic, text capture, score ladders."""
