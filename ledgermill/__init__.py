"""Layered finance tables on Spark: bronze, silver and gold Parquet, checks, and reports."""
