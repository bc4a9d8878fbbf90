"""Tables in buckets by a key, so that joins and sums by it need no shuffle.

Spark knows the buckets of a table by its catalog entry, so such a table is read by name. The
entry says where the files are; a session that has none makes its own from them. Rows of one
key are in one bucket and one task: meant for keys like an order, which have few rows each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table_name(path: str) -> str:
    """The catalog name of the table below ``path``."""
    return "bucketed_" + re.sub(r"[^0-9a-z]+", "_", path.lower()).strip("_")


def write_bucketed(
    df: DataFrame, path: str, key: str, buckets: int, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Writes ``df`` in ``buckets`` by ``key``, sorted by it, and returns the table.

    Rows are dealt by the hash that buckets go by, so each task writes one bucket's files.
    A table that was there before is replaced.
    """
    spark = df.sparkSession
    name = table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name, format="parquet")
    return spark.table(name)


def read_bucketed(
    spark: SparkSession,
    path: str,
    schema: StructType,
    key: str,
    buckets: int,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """The table that ``write_bucketed`` wrote below ``path``, by whichever session."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(
            f"`{field.name}` {field.dataType.simpleString()}"
            for field in sorted(schema, key=lambda field: field.name in partition_by)
        )
        parts = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {parts} CLUSTERED BY ({key}) "
            f"SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if partition_by:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name).select(*schema.names)
