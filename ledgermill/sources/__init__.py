"""Reading source tables, and reading, writing and publishing layers."""
