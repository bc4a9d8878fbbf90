"""Surrogate keys, date keys and the unknown member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_KEY = -1
UNKNOWN_TEXT = "Unknown"


def surrogate_key(business_key: str) -> Column:
    """The business key itself, as a bigint.

    Business keys are unique, and checked not to be negative, so two members never share
    a key, the same key comes out of every run, and ``UNKNOWN_KEY`` stays free.
    """
    return F.col(business_key).cast("bigint")


def known_or_unknown(key: Column) -> Column:
    return F.coalesce(key, F.lit(UNKNOWN_KEY).cast("bigint"))


def date_key(day: str) -> Column:
    """Date as a yyyyMMdd int; the unknown key where there is no date."""
    column = F.col(day)
    number = F.year(column) * 10000 + F.month(column) * 100 + F.day(column)
    return F.coalesce(number, F.lit(UNKNOWN_KEY))


def date_of_key(key: Column) -> Column:
    """The date a date key stands for; null for the unknown key."""
    number = F.make_date(
        F.floor(key / 10000).cast("int"), F.floor(key / 100).cast("int") % 100, key % 100
    )
    return F.when(key > 0, number)


def with_unknown_member(dimension: DataFrame, **members: object) -> DataFrame:
    """Adds the row that facts without a known member point at.

    ``members`` gives its column values; columns left out are null.
    """
    row = dimension.sparkSession.range(1).select(
        *(
            F.lit(members.get(field.name)).cast(field.dataType).alias(field.name)
            for field in dimension.schema
        )
    )
    return dimension.unionByName(row)
