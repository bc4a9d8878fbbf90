"""Audit columns of the bronze layer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_audit(df: DataFrame, table: str, run_ts: datetime) -> DataFrame:
    """Adds where each row came from and which run landed it.

    ``df`` must come straight from a file scan, which supplies the file name.
    """
    return df.select(
        "*",
        F.lit(table).alias("_source_table"),
        F.col("_metadata.file_name").alias("_source_file"),
        F.lit(run_ts).cast("timestamp").alias("_ingested_at"),
    )
