"""Mergeable summaries of orders: distinct customers and quantiles of order value.

A month is summed up in two small sketches, and those of months merge to a year's, so years,
or months that were summed up in different loads, need no second pass over the facts. Both
are built per task before the shuffle, which then moves a few kilobytes per month and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2^14 registers: the standard error of a distinct count is 1.04 / sqrt(2^14), 0.8 %.
CUSTOMER_BITS = 14
# The share of orders below a quantile is off by less than 0.7 % with 99 % confidence.
VALUE_K = 400


def monthly_order_sketches(fact_orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Per month of the order, sketches of its customers and of its order totals in cents."""
    days = dim_date.select(F.col("date_key").alias("_date_key"), "year", "month")
    dated = fact_orders.join(days, F.col("order_date_key") == F.col("_date_key"), "left")
    cents = (F.col("order_total") * 100).cast("bigint")
    return dated.groupBy(
        F.col("year").alias("order_year"), F.col("month").alias("order_month")
    ).agg(
        F.hll_sketch_agg("customer_key", CUSTOMER_BITS).alias("customers"),
        F.kll_sketch_agg_bigint(cents, VALUE_K).alias("totals"),
    )


def merge_sketches(sketches: DataFrame, *groups: str) -> DataFrame:
    """The sketches of ``groups`` from those of their parts."""
    return sketches.groupBy(*groups).agg(
        F.hll_union_agg("customers").alias("customers"),
        F.kll_merge_agg_bigint("totals", VALUE_K).alias("totals"),
    )


def customer_count(sketch: str = "customers") -> Column:
    """About how many customers ordered."""
    return F.hll_sketch_estimate(sketch)


def order_value_quantiles(shares: Sequence[float], sketch: str = "totals") -> Column:
    """The order totals that about these shares of orders do not exceed."""
    found = F.kll_sketch_get_quantile_bigint(sketch, F.array(*map(F.lit, shares)))
    return F.transform(found, lambda cents: (cents / F.lit(100)).cast("decimal(18,2)"))


def order_value_spread(fact_orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Number, least and greatest total of each year's orders, merged from its months.

    Of all that the sketches know, these are exact.
    """
    years = merge_sketches(monthly_order_sketches(fact_orders, dim_date), "order_year")
    ends = order_value_quantiles([0.0, 1.0])
    return years.select(
        "order_year",
        F.kll_sketch_get_n_bigint("totals").alias("order_count"),
        ends[0].alias("least_total"),
        ends[1].alias("greatest_total"),
    )
