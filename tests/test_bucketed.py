from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.contracts import GOLD_DDL, cleaned_schema, gold_schema
from ledgermill.functions.amounts import with_amounts
from ledgermill.operators.checks import amount_recon
from ledgermill.plans import gold
from ledgermill.plans.pipeline import run_pipeline
from ledgermill.plans.silver import ok_rows
from ledgermill.sources.bucketed import read_bucketed, table_name, write_bucketed
from ledgermill.sources.runs import current_run, read_gold
from tests.test_plans import plan, settings

BUCKETS = 4


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def loads(spark, small_dir, tmp_path_factory):
    """The same source loaded with and without buckets, and the checks of both."""
    out = []
    for buckets in (None, BUCKETS):
        dst = str(tmp_path_factory.mktemp("load"))
        ts = datetime(2024, 3, 1, tzinfo=timezone.utc)
        out.append((dst, rows(run_pipeline(spark, small_dir, dst, ts, order_buckets=buckets))))
    return out


def test_buckets_change_no_row_and_no_check(spark, loads):
    (plain, plain_checks), (bucketed, bucketed_checks) = loads
    assert bucketed_checks == plain_checks
    for table in GOLD_DDL:
        assert rows(read_gold(spark, bucketed, table)) == rows(read_gold(spark, plain, table))


def test_lines_and_orders_meet_without_a_shuffle(spark, loads):
    run = current_run(spark, loads[1][0])

    def silver(name, key):
        path = run.path("silver", name)
        # As a session that did not write the table.
        spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
        return ok_rows(read_bucketed(spark, path, cleaned_schema(name), key, BUCKETS, ["row_status"]))

    lines, orders = silver("lineitem", "l_orderkey"), silver("orders", "o_orderkey")
    facts = read_bucketed(
        spark, run.path("gold", "fact_orders"), gold_schema("fact_orders"), "order_key", BUCKETS, ["order_year"]
    )
    assert (lines.count(), orders.count(), facts.count()) == (6000, 1500, 1500)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        sales = gold.fact_sales(gold.sales_lines(lines), facts)
        text = plan(sales)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert sales.count() == 6000
        recon = amount_recon(
            orders, with_amounts(lines), "silver", "orders", "o_orderkey", "o_totalprice",
            "l_orderkey", "total_amount", Decimal("1.00"),
        )
        assert "hashpartitioning" not in plan(recon)
        assert recon.first().failed > 0


def test_a_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).withColumn("v", F.col("id") % 3)
    write_bucketed(df, path, "id", 3)
    again = write_bucketed(df.where("id < 10"), path, "id", 3)
    assert again.count() == 10
    spark.sql(f"DROP TABLE {table_name(path)}")
    assert write_bucketed(df, path, "id", 3).count() == 100
    assert read_bucketed(spark, path, df.schema, "id", 3).where("v = 1").count() == 33
