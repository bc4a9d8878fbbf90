"""Typed columns for silver.

Every cast is a ``try_cast``: a value that does not fit becomes null and is
counted by the not-null checks, where a plain cast would end the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(name: str) -> Column:
    return F.col(name).try_cast("bigint").alias(name)


def whole(name: str) -> Column:
    return F.col(name).try_cast("int").alias(name)


def money(name: str) -> Column:
    return F.col(name).try_cast("decimal(18,2)").alias(name)


def rate(name: str) -> Column:
    return F.col(name).try_cast("decimal(5,2)").alias(name)


def day(name: str) -> Column:
    return F.col(name).try_cast("date").alias(name)


def text(name: str) -> Column:
    return F.trim(F.col(name)).alias(name)
