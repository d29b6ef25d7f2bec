"""Column recipes."""
