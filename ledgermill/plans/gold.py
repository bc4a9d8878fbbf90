"""Gold: dimensions and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.amounts import with_amounts
from ledgermill.functions.calendar import calendar_days, with_calendar_columns
from ledgermill.functions.keys import (
    UNKNOWN_KEY,
    UNKNOWN_TEXT,
    date_key,
    known_or_unknown,
    surrogate_key,
    with_unknown_member,
)


def dim_date(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per day of the whole years that order and ship dates fall in.

    Its size is that of the calendar, however many rows the facts have.
    """
    used = (
        orders.agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))
        .unionByName(
            lineitem.agg(F.min("l_shipdate").alias("low"), F.max("l_shipdate").alias("high"))
        )
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    bounds = used.select(
        F.make_date(F.year("low"), F.lit(1), F.lit(1)).alias("first_day"),
        F.make_date(F.year("high"), F.lit(12), F.lit(31)).alias("last_day"),
    )
    return with_calendar_columns(calendar_days(bounds))


def dim_customer(customer: DataFrame, geography: DataFrame) -> DataFrame:
    located = _with_geography(customer, "c_nationkey", geography)
    members = located.select(
        surrogate_key("c_custkey").alias("customer_key"),
        "c_custkey",
        F.col("c_name").alias("customer_name"),
        _or_unknown("c_mktsegment").alias("market_segment"),
        F.col("c_acctbal").alias("account_balance"),
        "nation_name",
        "region_name",
    )
    return with_unknown_member(
        members,
        customer_key=UNKNOWN_KEY,
        customer_name=UNKNOWN_TEXT,
        market_segment=UNKNOWN_TEXT,
        nation_name=UNKNOWN_TEXT,
        region_name=UNKNOWN_TEXT,
    )


def dim_product(part: DataFrame) -> DataFrame:
    members = part.select(
        surrogate_key("p_partkey").alias("product_key"),
        "p_partkey",
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("product_type"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("retail_price"),
    )
    return with_unknown_member(
        members,
        product_key=UNKNOWN_KEY,
        product_name=UNKNOWN_TEXT,
        brand=UNKNOWN_TEXT,
        product_type=UNKNOWN_TEXT,
    )


def dim_supplier(supplier: DataFrame, geography: DataFrame) -> DataFrame:
    located = _with_geography(supplier, "s_nationkey", geography)
    members = located.select(
        surrogate_key("s_suppkey").alias("supplier_key"),
        "s_suppkey",
        F.col("s_name").alias("supplier_name"),
        F.col("s_acctbal").alias("account_balance"),
        "nation_name",
        "region_name",
    )
    return with_unknown_member(
        members,
        supplier_key=UNKNOWN_KEY,
        supplier_name=UNKNOWN_TEXT,
        nation_name=UNKNOWN_TEXT,
        region_name=UNKNOWN_TEXT,
    )


def order_headers(orders: DataFrame) -> DataFrame:
    """One row per order, with what is known without its customer."""
    return orders.select(
        F.col("o_orderkey").alias("order_key"),
        "o_custkey",
        date_key("o_orderdate").alias("order_date_key"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"),
        F.col("o_totalprice").alias("order_total"),
        F.coalesce(F.year("o_orderdate"), F.lit(UNKNOWN_KEY)).alias("order_year"),
    )


def fact_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per order.

    Market segment and region of the customer are carried along: reports group
    by them, and the customer dimension is too big to be joined for that alone.
    """
    known = customers.select("c_custkey", "customer_key", "market_segment", "region_name")
    headers = order_headers(orders)
    joined = headers.join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        "order_key",
        "order_date_key",
        known_or_unknown(F.col("customer_key")).alias("customer_key"),
        _or_unknown("market_segment").alias("market_segment"),
        _or_unknown("region_name").alias("region_name"),
        "order_status",
        "order_priority",
        "order_total",
        "order_year",
    )


def sales_lines(
    lineitem: DataFrame, products: DataFrame | None = None, suppliers: DataFrame | None = None
) -> DataFrame:
    """One row per sales line, with what is known without its order.

    Products and suppliers are looked up in the dimensions given. Left out, the
    foreign keys count as checked already (silver does that) and the surrogate
    key is computed from them, which spares two shuffles of the sales lines.
    """
    lines = with_amounts(lineitem)
    product_key = surrogate_key("l_partkey")
    if products is not None:
        lines = lines.join(
            products.select("p_partkey", "product_key"),
            F.col("l_partkey") == F.col("p_partkey"),
            "left",
        )
        product_key = F.col("product_key")
    supplier_key = surrogate_key("l_suppkey")
    if suppliers is not None:
        lines = lines.join(
            suppliers.select("s_suppkey", "supplier_key"),
            F.col("l_suppkey") == F.col("s_suppkey"),
            "left",
        )
        supplier_key = F.col("supplier_key")
    return lines.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        date_key("l_shipdate").alias("ship_date_key"),
        known_or_unknown(product_key).alias("product_key"),
        known_or_unknown(supplier_key).alias("supplier_key"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_quantity").alias("quantity"),
        "gross_amount",
        "discount_amount",
        "net_amount",
        "tax_amount",
        "total_amount",
    )


def fact_sales(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Sales lines with the date and customer of their order, taken from its facts."""
    header = orders.select(
        "order_key", "order_date_key", "customer_key", "market_segment", "region_name", "order_year"
    )
    no_date = F.lit(UNKNOWN_KEY)
    return lines.join(header, "order_key", "left").select(
        "order_key",
        "line_number",
        F.coalesce("order_date_key", no_date).alias("order_date_key"),
        "ship_date_key",
        known_or_unknown(F.col("customer_key")).alias("customer_key"),
        "product_key",
        "supplier_key",
        _or_unknown("market_segment").alias("market_segment"),
        _or_unknown("region_name").alias("region_name"),
        "return_flag",
        "line_status",
        "quantity",
        "gross_amount",
        "discount_amount",
        "net_amount",
        "tax_amount",
        "total_amount",
        F.coalesce("order_year", no_date).alias("order_year"),
    )


def dated_sales(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Sales lines with the date of their order alone, for reports without customers."""
    dates = headers.select("order_key", "order_date_key")
    dated = lines.join(dates, "order_key", "left")
    known = F.coalesce("order_date_key", F.lit(UNKNOWN_KEY))
    return dated.withColumn("order_date_key", known)


def _with_geography(df: DataFrame, nation_key: str, geography: DataFrame) -> DataFrame:
    located = df.join(geography, F.col(nation_key) == F.col("n_nationkey"), "left")
    return located.withColumns(
        {"nation_name": _or_unknown("n_name"), "region_name": _or_unknown("r_name")}
    )


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(UNKNOWN_TEXT))
