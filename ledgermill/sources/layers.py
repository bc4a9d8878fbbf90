"""Reading source tables and reading and writing layer tables, all Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgermill.operators.checks import schema_problems


class SchemaMismatch(Exception):
    """A table about to be written does not match its contract."""


def read_source(spark: SparkSession, src_dir: str, table: str) -> DataFrame:
    """A source table as found, with the types of the file."""
    return spark.read.parquet(f"{src_dir}/{table}.parquet")


def read_layer(
    spark: SparkSession, path: str, contract: StructType | None = None
) -> DataFrame:
    """A layer table, with the columns of its contract even where it has no rows."""
    reader = spark.read if contract is None else spark.read.schema(contract)
    return reader.parquet(path)


def check_contract(df: DataFrame, path: str, contract: StructType) -> None:
    problems = schema_problems(df, contract)
    if problems:
        raise SchemaMismatch(f"{path}: {'; '.join(problems)}")


def write_layer(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    contract: StructType | None = None,
    only_given_partitions: bool = False,
) -> None:
    """Writes a table so that a re-run replaces what it wrote before.

    The whole table is replaced, or, with ``only_given_partitions``, the
    partitions that ``df`` has rows for. ``df`` must not read from ``path``.
    """
    if contract is not None:
        check_contract(df, path, contract)
    replaced = "dynamic" if only_given_partitions else "static"
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", replaced)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def spread_for_write(df: DataFrame, partition: str, sort_by: str) -> DataFrame:
    """Gathers each partition's rows into few, evenly sized files.

    ``rebalance`` brings rows of a partition together and lets adaptive
    execution cut big ones into several tasks, where ``repartition`` would send
    a whole year to one. The sort lets readers skip row groups by ``sort_by``.
    """
    return df.hint("rebalance", partition).sortWithinPartitions(partition, sort_by)
