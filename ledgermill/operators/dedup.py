"""Removing copies of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_dedup(df: DataFrame, copies: str | None = None) -> DataFrame:
    """Keeps one of each set of rows that are equal in every column.

    Copies are merged before the shuffle, so a row repeated very often does not
    load one task. ``copies`` names a column for how many rows each kept row
    stands for, so that row counts can be reconciled afterwards.
    """
    if copies is None:
        return df.dropDuplicates()
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keeps the first row of each key in ``order``, which must leave no ties.

    Spark turns the filter on the row number into a limit that runs before the
    shuffle as well, so at most one row per key and input task is moved.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_position", F.row_number().over(newest_first))
        .filter(F.col("_position") == 1)
        .drop("_position")
    )
