"""Dimensions, facts and reports on small hand-made tables, and invariants on the fixtures."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from ledgermill.contracts import GOLD_DDL, SILVER_DDL, gold_schema, silver_schema
from ledgermill.functions.keys import UNKNOWN_KEY
from ledgermill.operators.checks import schema_problems
from ledgermill.plans import analytics, gold
from ledgermill.plans.silver import silver_geography
from ledgermill.registry import Chain


def money(text):
    return Decimal(text)


@pytest.fixture(scope="module")
def shop(spark):
    """Two customers, one of an unknown nation; an order of no known customer."""
    tables = {
        "region": [(1, "EUROPE")],
        "nation": [(1, "FRANCE", 1), (2, "ATLANTIS", 9)],
        "customer": [
            (1, "Ada", 1, money("10.00"), "BUILDING"),
            (2, "Bob", 77, money("-5.00"), None),
            (3, "Cy", 2, money("0.00"), "MACHINERY"),
        ],
        "supplier": [(1, "Sup", 1, money("1.00"))],
        "part": [(1, "Nut", "Brand#1", "PROMO", 3, money("2.00"))],
        "orders": [
            (1, 1, "F", money("100.00"), date(1999, 12, 31), "5-LOW"),
            (2, 2, "O", money("50.00"), date(2000, 2, 29), "5-LOW"),
            (3, 99, "X", money("7.00"), date(2000, 3, 1), "5-LOW"),
            (4, None, None, money("3.00"), None, None),
        ],
        "lineitem": [
            (1, 1, 1, 1, "1", "10.00", "0.10", "0.05", "A", "F", date(2000, 1, 5)),
            (1, 9, 1, 2, "1", "20.00", "0.00", "0.00", "A", "F", date(2000, 1, 5)),
            (2, 1, None, 1, "1", "30.00", "0.00", "0.00", "N", "O", date(2000, 3, 1)),
            (4, None, 9, 1, "1", "40.00", "0.00", "0.00", "R", "O", None),
            (88, 1, 1, 1, "1", "50.00", "0.00", "0.00", "R", "O", date(2000, 3, 2)),
        ],
    }
    tables["lineitem"] = [
        (*row[:4], *(money(value) for value in row[4:8]), *row[8:]) for row in tables["lineitem"]
    ]
    silver = {
        table: spark.createDataFrame(rows, silver_schema(table)) for table, rows in tables.items()
    }
    geography = silver_geography(silver["nation"], silver["region"])
    built = {
        "dim_date": gold.dim_date(silver["orders"], silver["lineitem"]),
        "dim_customer": gold.dim_customer(silver["customer"], geography),
        "dim_product": gold.dim_product(silver["part"]),
        "dim_supplier": gold.dim_supplier(silver["supplier"], geography),
    }
    built["fact_orders"] = gold.fact_orders(silver["orders"], built["dim_customer"])
    lines = gold.sales_lines(silver["lineitem"], built["dim_product"], built["dim_supplier"])
    built["fact_sales"] = gold.fact_sales(lines, built["fact_orders"])
    return silver | built


def test_geography_keeps_nations_of_no_known_region(shop):
    rows = silver_geography(shop["nation"], shop["region"]).collect()
    assert {(row.n_name, row.r_name) for row in rows} == {
        ("FRANCE", "EUROPE"),
        ("ATLANTIS", "Unknown"),
    }


def test_dim_customer_has_every_customer_and_the_unknown_member(shop):
    rows = {row.c_custkey: row for row in shop["dim_customer"].collect()}
    assert set(rows) == {1, 2, 3, None}
    assert (rows[1].nation_name, rows[1].region_name) == ("FRANCE", "EUROPE")
    assert (rows[2].nation_name, rows[2].market_segment) == ("Unknown", "Unknown")
    assert (rows[3].nation_name, rows[3].region_name) == ("ATLANTIS", "Unknown")
    assert (rows[None].customer_key, rows[None].customer_name) == (UNKNOWN_KEY, "Unknown")


def test_dim_date_covers_whole_years(shop):
    first, last, days = shop["dim_date"].agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert (first, last, days) == (date(1999, 1, 1), date(2000, 12, 31), 365 + 366)


def test_facts_point_at_the_unknown_member(shop):
    orders = {row.order_key: row for row in shop["fact_orders"].collect()}
    assert len(orders) == 4
    assert orders[3].customer_key == orders[4].customer_key == UNKNOWN_KEY
    assert (orders[4].order_date_key, orders[4].order_year) == (-1, -1)
    assert orders[3].market_segment == "Unknown"

    lines = {(row.order_key, row.line_number): row for row in shop["fact_sales"].collect()}
    assert len(lines) == 5
    assert lines[1, 2].product_key == UNKNOWN_KEY
    assert lines[2, 1].supplier_key == UNKNOWN_KEY
    assert lines[4, 1].product_key == lines[4, 1].supplier_key == UNKNOWN_KEY
    assert lines[4, 1].ship_date_key == -1
    lost = lines[88, 1]
    assert (lost.customer_key, lost.order_date_key, lost.order_year) == (-1, -1, -1)


def test_keys_computed_and_looked_up_agree(shop):
    """On lines whose part and supplier exist or are missing, as silver lets through."""
    lines = shop["lineitem"].filter("coalesce(l_partkey, 1) = 1 and coalesce(l_suppkey, 1) = 1")
    looked_up = gold.sales_lines(lines, shop["dim_product"], shop["dim_supplier"])
    assertDataFrameEqual(gold.sales_lines(lines), looked_up)


def test_no_report_loses_a_fact(shop):
    net = sum(row.net_amount for row in shop["fact_sales"].collect())
    total = sum(row.order_total for row in shop["fact_orders"].collect())

    def summed(df, column):
        return sum(row[column] for row in df.collect())

    sales, orders, days = shop["fact_sales"], shop["fact_orders"], shop["dim_date"]
    assert summed(analytics.revenue_monthly(sales, days), "net_revenue") == net
    assert summed(analytics.gross_to_net(sales, days), "net") == net
    pivot = analytics.status_pivot(orders, days)
    assert sum(
        summed(pivot, c) for c in ("status_f", "status_o", "status_p", "status_other")
    ) == total
    assert summed(analytics.customer_pareto(orders, shop["dim_customer"]), "order_total") == total
    rollup = analytics.revenue_rollup(orders, days)
    assert summed(rollup.filter("subtotal_level = 0"), "order_total") == total
    assert summed(rollup.filter("subtotal_level = 3"), "order_total") == total
    cube = analytics.revenue_cube(sales)
    for level in range(4):
        assert summed(cube.filter(f"subtotal_level = {level}"), "net_revenue") == net


def test_status_pivot_shows_unlisted_statuses(shop):
    rows = {row.order_year: row for row in
            analytics.status_pivot(shop["fact_orders"], shop["dim_date"]).collect()}
    assert rows[2000].status_o == money("50.00")
    assert rows[2000].status_other == money("7.00")
    assert rows[2000].status_f == 0
    assert rows[None].status_other == money("3.00")


def test_recency_lists_customers_without_orders(shop):
    rows = {row.c_custkey: row for row in
            analytics.customer_recency(shop["fact_orders"], shop["dim_customer"]).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1].last_order_date, rows[1].days_since_last_order) == (date(1999, 12, 31), 61)
    assert (rows[2].days_since_last_order, rows[2].order_count) == (1, 1)
    none = rows[3]
    assert (none.last_order_date, none.days_since_last_order) == (None, None)
    assert (none.order_count, none.order_total) == (0, 0)


@pytest.fixture(scope="module")
def months(spark):
    """Sales facts of single months, with gaps and a month that nets to zero."""
    amounts = {
        (1999, 1): "100.0000",
        (1999, 3): "0.0000",
        (2000, 1): "150.0000",
        (2000, 2): "10.0000",
        (2000, 3): "5.0000",
        (2000, 5): "1.0000",
    }
    facts = spark.createDataFrame(
        [(y * 10000 + m * 100 + 1, money(v)) for (y, m), v in amounts.items()],
        "order_date_key int, net_amount decimal(18,4)",
    )
    days = gold.dim_date(
        spark.createDataFrame([(date(1999, 1, 1),)], "o_orderdate date"),
        spark.createDataFrame([(date(2000, 5, 1),)], "l_shipdate date"),
    )
    return facts, days


def by_month(df):
    return {(row.order_year, row.order_month): row for row in df.collect()}


def test_yoy_goes_by_calendar_and_not_by_position(months):
    rows = by_month(analytics.revenue_yoy(*months))
    assert rows[2000, 1].growth == 0.5
    assert rows[2000, 2].prior_year_revenue is None and rows[2000, 2].growth is None
    assert rows[2000, 3].prior_year_revenue == 0 and rows[2000, 3].growth is None
    assert rows[1999, 1].prior_year_revenue is None


def test_ytd_starts_over_each_year(months):
    rows = by_month(analytics.revenue_ytd(*months))
    assert [rows[m].ytd_revenue for m in sorted(rows)] == [
        money(v) for v in ("100", "100", "150", "160", "165", "166")
    ]


def test_moving_window_goes_by_calendar(months):
    rows = by_month(analytics.revenue_moving_3m(*months))
    assert (rows[1999, 3].moving_sum, rows[1999, 3].moving_average) == (100, 50.0)
    assert (rows[2000, 3].moving_sum, rows[2000, 3].moving_average) == (165, 55.0)
    assert (rows[2000, 5].moving_sum, rows[2000, 5].moving_average) == (6, 3.0)


def test_top_customers_include_ties(spark, months):
    _, days = months
    facts = spark.createDataFrame(
        [(20000101, key, money(min(key, 10) * -1)) for key in range(1, 15)],
        "order_date_key int, customer_key bigint, net_amount decimal(18,4)",
    )
    customers = spark.createDataFrame(
        [(key, key, f"c{key}") for key in range(1, 15)],
        "customer_key bigint, c_custkey bigint, customer_name string",
    )
    rows = analytics.top_customers(facts, days, customers).collect()
    assert sorted(row.customer_rank for row in rows) == [*range(1, 10), *[10] * 5]
    assert {row.customer_name for row in rows if row.customer_rank == 1} == {"c1"}


@pytest.fixture(scope="module")
def chain(spark, small_dir):
    return Chain(spark, small_dir)


@pytest.mark.parametrize("table", sorted(SILVER_DDL))
def test_silver_contracts(chain, table):
    assert schema_problems(chain.silver[table], silver_schema(table)) == []


@pytest.mark.parametrize("table", sorted(GOLD_DDL))
def test_gold_contracts(chain, table):
    assert schema_problems(chain.gold[table], gold_schema(table)) == []


def test_facts_have_one_row_per_silver_row(chain):
    assert chain.fact_sales_looked_up.count() == chain.silver["lineitem"].count()
    assert chain.gold["fact_orders"].count() == chain.silver["orders"].count()


def test_every_fact_key_is_in_its_dimension(chain):
    sales = chain.fact_sales_looked_up
    for dimension, key in (
        (chain.gold["dim_customer"], "customer_key"),
        (chain.gold["dim_product"], "product_key"),
        (chain.gold["dim_supplier"], "supplier_key"),
    ):
        assert sales.join(dimension, key, "left_anti").count() == 0
    for date_key in ("order_date_key", "ship_date_key"):
        days = chain.gold["dim_date"].withColumnRenamed("date_key", date_key)
        assert sales.join(days, date_key, "left_anti").count() == 0


def test_net_of_facts_is_net_of_silver(chain):
    net = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(38,4)")
    assert chain.fact_sales_looked_up.agg(F.sum("net_amount").cast("decimal(38,4)")).first()[0] == (
        chain.silver["lineitem"].agg(net).first()[0]
    )
