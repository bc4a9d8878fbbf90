"""Calendar rows for a date dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.keys import date_key


def calendar_days(bounds: DataFrame) -> DataFrame:
    """One row per day from ``first_day`` to ``last_day`` of the one row given."""
    return bounds.select(
        F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("date")
    )


def with_calendar_columns(days: DataFrame) -> DataFrame:
    day = F.col("date")
    weekday = F.weekday(day) + 1
    return days.select(
        date_key("date").alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.day(day).alias("day"),
        weekday.alias("iso_weekday"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.weekofyear(day).alias("iso_week"),
        F.extract(F.lit("YEAROFWEEK"), day).alias("iso_year"),
        F.dayofyear(day).alias("day_of_year"),
        (weekday >= 6).alias("is_weekend"),
        (day == F.last_day(day)).alias("is_month_end"),
    )
