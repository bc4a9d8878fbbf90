"""Bronze: source tables landed unchanged, with audit columns."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.contracts import SOURCE_TABLES
from ledgermill.functions.audit import with_audit
from ledgermill.operators.union import union_all
from ledgermill.sources.layers import read_source


def ingest(spark: SparkSession, src_dir: str, table: str, run_ts: datetime) -> DataFrame:
    return with_audit(read_source(spark, src_dir, table), table, run_ts)


def source_tables(spark: SparkSession, src_dir: str) -> dict[str, DataFrame]:
    return {table: read_source(spark, src_dir, table) for table in SOURCE_TABLES}


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    return union_all(
        *(
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(table).alias("table_name"), "n_rows"
            )
            for table, df in tables.items()
        )
    )
