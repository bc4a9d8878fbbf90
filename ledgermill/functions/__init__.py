"""Column and row helpers, all built from Spark's own functions."""
