"""Reports on the gold tables.

Facts are left-joined to dimensions and so never lose a row: a fact without a
date shows up under a null year. Windows without a partition run over rows that
were aggregated to months before, and a calendar has few of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.contracts import ACCEPTED_VALUES
from ledgermill.functions.keys import UNKNOWN_KEY, date_of_key
from ledgermill.operators.running import running_total

TOP_CUSTOMERS = 10


def revenue_monthly(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Net revenue, tax and lines per month of order and market segment."""
    return (
        _with_calendar(fact_sales, "order_date_key", dim_date, "year", "month")
        .groupBy(
            F.col("year").alias("order_year"),
            F.col("month").alias("order_month"),
            "market_segment",
        )
        .agg(
            _total("net_amount", 4).alias("net_revenue"),
            _total("tax_amount", 6).alias("tax"),
            F.count(F.lit(1)).alias("line_count"),
        )
    )


def revenue_rollup(fact_orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Order totals per quarter, per year and in all.

    ``subtotal_level`` is 0 for a quarter, 1 for a year and 3 for the grand
    total. Orders are summed to quarters first; only those few rows are expanded.
    """
    quarters = (
        _with_calendar(fact_orders, "order_date_key", dim_date, "year", "quarter")
        .groupBy("year", "quarter")
        .agg(_total("order_total", 2).alias("order_total"), F.count(F.lit(1)).alias("n"))
    )
    return (
        quarters.rollup("year", "quarter")
        .agg(
            _total("order_total", 2).alias("order_total"),
            F.sum("n").alias("order_count"),
            F.grouping_id().cast("int").alias("subtotal_level"),
        )
        .select(
            F.col("year").alias("order_year"),
            F.col("quarter").alias("order_quarter"),
            "order_total",
            "order_count",
            "subtotal_level",
        )
    )


def revenue_cube(fact_sales: DataFrame) -> DataFrame:
    """Net revenue by customer region and market segment, with all subtotals.

    ``subtotal_level`` is 0 for a pair, 1 for a region over all segments, 2 for a
    segment over all regions and 3 for the grand total.
    """
    pairs = fact_sales.groupBy("region_name", "market_segment").agg(
        _total("net_amount", 4).alias("net_revenue")
    )
    return pairs.cube("region_name", "market_segment").agg(
        _total("net_revenue", 4).alias("net_revenue"),
        F.grouping_id().cast("int").alias("subtotal_level"),
    )


def revenue_yoy(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Each month against the same month a year before.

    The window goes by the number of the month, so a month without sales does
    not shift the comparison. Growth is null where there is nothing to compare.
    """
    year_before = Window.orderBy(_month_number()).rangeBetween(-12, -12)
    months = _monthly_net(fact_sales, dim_date).withColumn(
        # Sales without a month form a row whose frame would be the row itself.
        "prior_year_revenue",
        F.when(F.col("order_month").isNotNull(), F.max("net_revenue").over(year_before)),
    )
    change = (F.col("net_revenue") - F.col("prior_year_revenue")).cast("double")
    growth = F.try_divide(change, F.col("prior_year_revenue").cast("double"))
    return months.withColumn("growth", F.round(growth, 6))


def revenue_ytd(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Net revenue from the start of the year to each month."""
    so_far = (
        Window.partitionBy("order_year")
        .orderBy("order_month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return _monthly_net(fact_sales, dim_date).withColumn(
        "ytd_revenue", F.sum("net_revenue").over(so_far).cast("decimal(38,4)")
    )


def revenue_moving_3m(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Sum and monthly average over a month and the two before it.

    The average is over the months of those three that had sales.
    """
    three_months = Window.orderBy(_month_number()).rangeBetween(-2, 0)
    dated = F.col("order_month").isNotNull()
    total = F.when(dated, F.sum("net_revenue").over(three_months))
    months = F.when(dated, F.count("net_revenue").over(three_months))
    return (
        _monthly_net(fact_sales, dim_date)
        .withColumns({"moving_sum": total.cast("decimal(38,4)"), "_months": months})
        .withColumn(
            "moving_average", F.round(F.col("moving_sum").cast("double") / F.col("_months"), 4)
        )
        .drop("_months")
    )


def top_customers(
    fact_sales: DataFrame, dim_date: DataFrame, dim_customer: DataFrame
) -> DataFrame:
    """The ten customers with the highest net revenue of each year, ties included.

    Spark applies the rank limit before the shuffle too, so a year is not
    gathered in one task.
    """
    per_customer = (
        _with_calendar(fact_sales, "order_date_key", dim_date, "year")
        .groupBy(F.col("year").alias("order_year"), "customer_key")
        .agg(_total("net_amount", 4).alias("net_revenue"))
    )
    best_first = Window.partitionBy("order_year").orderBy(F.desc("net_revenue"))
    top = per_customer.withColumn("customer_rank", F.rank().over(best_first)).filter(
        F.col("customer_rank") <= TOP_CUSTOMERS
    )
    names = dim_customer.select("customer_key", "c_custkey", "customer_name")
    # Every key is in the dimension; an inner join lets Spark broadcast the few top rows.
    return top.join(names, "customer_key").select(
        "order_year", "customer_rank", "c_custkey", "customer_name", "net_revenue"
    )


def customer_pareto(fact_orders: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Share and running share of each customer in the order value of their region."""
    per_customer = fact_orders.groupBy("customer_key").agg(
        _total("order_total", 2).alias("order_total")
    )
    located = per_customer.join(
        dim_customer.select("customer_key", "c_custkey", "region_name"), "customer_key"
    )
    running = running_total(
        located, "region_name", ["-order_total", "c_custkey"], "order_total"
    )
    region_total = F.col("group_total").cast("double")
    return running.select(
        "region_name",
        "c_custkey",
        "order_total",
        F.col("running_total").cast("decimal(38,2)").alias("running_total"),
        F.round(F.try_divide(F.col("order_total").cast("double"), region_total), 8).alias(
            "share"
        ),
        F.round(F.try_divide(F.col("running_total").cast("double"), region_total), 8).alias(
            "running_share"
        ),
    )


def customer_recency(fact_orders: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Days from each customer's last order to the newest order of all.

    Customers without an order are listed with no date, no days and a count of 0.
    """
    newest = date_of_key(fact_orders.select(F.max("order_date_key")).scalar())
    per_customer = fact_orders.groupBy("customer_key").agg(
        F.max("order_date_key").alias("last_key"),
        F.count(F.lit(1)).alias("n"),
        _total("order_total", 2).alias("total"),
    )
    members = dim_customer.filter(F.col("customer_key") != UNKNOWN_KEY)
    last = date_of_key(F.col("last_key"))
    return (
        members.select("customer_key", "c_custkey")
        .join(per_customer, "customer_key", "left")
        .select(
            "c_custkey",
            last.alias("last_order_date"),
            F.datediff(newest, last).alias("days_since_last_order"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("order_count"),
            F.coalesce("total", F.lit(0)).cast("decimal(38,2)").alias("order_total"),
        )
    )


def gross_to_net(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """From gross to total amount per ship year and return flag."""
    return (
        _with_calendar(fact_sales, "ship_date_key", dim_date, "year")
        .groupBy(F.col("year").alias("ship_year"), "return_flag")
        .agg(
            _total("gross_amount", 2).alias("gross"),
            _total("discount_amount", 4).alias("discount"),
            _total("net_amount", 4).alias("net"),
            _total("tax_amount", 6).alias("tax"),
            _total("total_amount", 6).alias("total"),
        )
    )


def status_pivot(fact_orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Order value per year, one column per status; any other status is in its own."""
    statuses = ACCEPTED_VALUES["orders", "o_orderstatus"]
    known = F.col("order_status").isin(*statuses)
    columns = {status: f"status_{status.lower()}" for status in (*statuses, "OTHER")}
    pivoted = (
        _with_calendar(fact_orders, "order_date_key", dim_date, "year")
        .withColumn("status", F.when(known, F.col("order_status")).otherwise("OTHER"))
        .groupBy(F.col("year").alias("order_year"))
        .pivot("status", list(columns))
        .agg(_total("order_total", 2))
    )
    return pivoted.select(
        "order_year",
        *(
            F.coalesce(F.col(status), F.lit(0)).cast("decimal(38,2)").alias(name)
            for status, name in columns.items()
        ),
    )


def _with_calendar(
    facts: DataFrame, fact_key: str, dim_date: DataFrame, *columns: str
) -> DataFrame:
    days = dim_date.select(F.col("date_key").alias("_date_key"), *columns)
    return facts.join(days, F.col(fact_key) == F.col("_date_key"), "left")


def _monthly_net(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    return (
        _with_calendar(fact_sales, "order_date_key", dim_date, "year", "month")
        .groupBy(F.col("year").alias("order_year"), F.col("month").alias("order_month"))
        .agg(_total("net_amount", 4).alias("net_revenue"))
    )


def _month_number() -> Column:
    return F.col("order_year") * 12 + F.col("order_month")


def _total(amount: str, scale: int) -> Column:
    return F.sum(amount).cast(f"decimal(38,{scale})")
