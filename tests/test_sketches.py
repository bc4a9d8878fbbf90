from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgermill.plans.sketches import (
    customer_count,
    merge_sketches,
    monthly_order_sketches,
    order_value_quantiles,
)
from ledgermill.registry import Chain

SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]


@pytest.fixture(scope="module")
def chain(spark, oracle_dir):
    return Chain(spark, oracle_dir)


def test_sketches_are_close_to_exact_counts_and_ranks(chain):
    facts, days = chain.gold["order_headers"], chain.gold["dim_date"]
    facts = facts.withColumnRenamed("o_custkey", "customer_key")
    years = merge_sketches(monthly_order_sketches(facts, days), "order_year")
    found = years.select(
        "order_year", customer_count().alias("n"), order_value_quantiles(SHARES).alias("q")
    )
    exact = facts.groupBy("order_year").agg(
        F.countDistinct("customer_key").alias("customers"), F.collect_list("order_total").alias("totals")
    )
    rows = found.join(exact, "order_year").collect()
    assert len(rows) == 7
    for row in rows:
        # Four standard errors.
        assert abs(row.n - row.customers) <= 0.033 * row.customers
        totals = sorted(row.totals)
        for share, value in zip(SHARES, row.q, strict=True):
            rank = sum(t <= value for t in totals) / len(totals)
            assert abs(rank - share) <= 0.01


def test_merging_in_steps_is_merging_at_once(chain):
    facts = chain.gold["order_headers"].withColumnRenamed("o_custkey", "customer_key")
    months = monthly_order_sketches(facts, chain.gold["dim_date"])
    at_once = merge_sketches(months.withColumn("all", F.lit(1)), "all")
    by_year = merge_sketches(months, "order_year").withColumn("all", F.lit(1))
    counts = [
        s.select(customer_count(), F.kll_sketch_get_n_bigint("totals")).first()
        for s in (at_once, merge_sketches(by_year, "all"))
    ]
    assert counts[0][1] == counts[1][1] == 15_000
    assert abs(counts[0][0] - counts[1][0]) <= 0.02 * counts[0][0]


def test_no_orders_and_null_totals(spark, chain):
    schema = "order_date_key int, customer_key bigint, order_total decimal(18,2)"
    days = chain.gold["dim_date"]
    assert monthly_order_sketches(spark.createDataFrame([], schema), days).collect() == []
    some = spark.createDataFrame([(19960101, 1, None), (-1, None, None)], schema)
    assert merge_sketches(monthly_order_sketches(some, days), "order_year").count() == 2
