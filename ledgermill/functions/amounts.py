"""Exact money amounts of a sales line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_amounts(lineitem: DataFrame) -> DataFrame:
    """Adds gross, discount, net, tax and total amounts.

    All are decimals of at most 18 digits, which Spark holds as one long. A
    product that does not fit becomes null, which stops the load at the checks on gold.
    """
    price = F.col("l_extendedprice")
    discount = (price * F.col("l_discount")).try_cast("decimal(18,4)")
    net = (price * (1 - F.col("l_discount"))).try_cast("decimal(18,4)")
    return (
        lineitem.withColumns(
            {"gross_amount": price, "discount_amount": discount, "net_amount": net}
        )
        .withColumn(
            "tax_amount", (F.col("net_amount") * F.col("l_tax")).try_cast("decimal(18,6)")
        )
        .withColumn(
            "total_amount",
            (F.col("net_amount") + F.col("tax_amount")).try_cast("decimal(18,6)"),
        )
    )
