"""Column expressions: no action, no shuffle."""
