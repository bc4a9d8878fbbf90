"""Plans Spark makes of the queries: what is read, shuffled and broadcast."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from ledgermill.registry import QUERIES
from ledgermill.operators.dedup import exact_dedup
from ledgermill.operators.foreign_keys import mark_orphans, orphan_keys, split_fk
from ledgermill.plans import analytics, gold, quality
from ledgermill.registry import Chain
from ledgermill.sources.layers import read_layer, spread_for_write, write_layer


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan adaptive execution ended up with."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def columns_read(text: str, prefix: str) -> set[str]:
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    return {
        field.split(":")[0]
        for schema in schemas
        for field in schema.split(",")
        if field.startswith(prefix)
    }


@pytest.fixture(scope="module")
def chain(spark, small_dir):
    return Chain(spark, small_dir)


# Joins of every pair of rows, Python workers, and rows gathered to be made one partition.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "Coalesce 1")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_holds_nothing_that_does_not_scale(spark, small_dir, name):
    """Also: whatever is exchanged into a single partition was aggregated before."""
    text = plan(QUERIES[name](spark, small_dir))
    assert not [word for word in UNWANTED if word in text]
    lines = text.splitlines()
    for number, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in lines[number + 1]


def test_report_reads_only_its_columns(chain):
    text = plan(analytics.revenue_cube(chain.gold["fact_sales"]))
    assert columns_read(text, "l_") == {"l_orderkey", "l_extendedprice", "l_discount"}
    assert columns_read(text, "o_") == {"o_orderkey", "o_custkey"}


def test_gross_to_net_shuffles_only_its_groups(spark, small_dir):
    text = plan(QUERIES["gross_to_net"](spark, small_dir))
    assert text.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in text


def test_manifest_reads_no_column(spark, small_dir):
    text = plan(QUERIES["bronze_manifest"](spark, small_dir))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {""}


def test_calendar_is_broadcast_by_its_estimated_size(chain):
    text = plan(analytics.revenue_rollup(chain.gold["fact_orders"], chain.gold["dim_date"]))
    assert re.search(r"BroadcastHashJoin \[order_date_key#\d+\], \[_date_key", text)


def test_latest_line_is_limited_before_the_shuffle(spark, small_dir):
    text = plan(QUERIES["silver_dedup_latest"](spark, small_dir))
    before_shuffle = text[text.index("Exchange hashpartitioning") :]
    assert "row_number(), 1, Partial" in before_shuffle


def test_top_customers_are_limited_before_the_shuffle(chain):
    text = plan(
        analytics.top_customers(
            chain.gold["fact_sales"], chain.gold["dim_date"], chain.gold["dim_customer"]
        )
    )
    assert re.search(r"WindowGroupLimit .*rank\(net_revenue#\d+\), 10, Partial", text)


def test_rows_are_not_shuffled_for_written_orphan_keys(spark, chain, tmp_path):
    """The one shuffle of the lines is that of the dedup; orphan keys are broadcast."""
    lines = chain.silver["lineitem"]
    orphans = {}
    for fk, table, pk in (
        ("l_orderkey", "orders", "o_orderkey"),
        ("l_partkey", "part", "p_partkey"),
    ):
        write_layer(orphan_keys(lines, chain.silver[table], fk, pk), str(tmp_path / fk))
        orphans[fk] = read_layer(spark, str(tmp_path / fk))
    text = plan(mark_orphans(exact_dedup(lines, copies="n"), orphans))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("BroadcastHashJoin") == 2


def test_many_orphan_keys_are_not_broadcast(spark, chain, tmp_path):
    path = str(tmp_path / "keys")
    write_layer(chain.silver["orders"].select(F.col("o_orderkey").alias("l_orderkey")), path)
    orphans = {"l_orderkey": read_layer(spark, path)}
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="1000"):
        text = plan(mark_orphans(chain.silver["lineitem"], orphans))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


# So small that the hot key of a test table counts as skewed.
SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10k",
}


@pytest.fixture
def hot_lines(chain):
    """Sales lines, a third or more of them of one order, part and supplier."""
    hot = F.col("l_orderkey") % 2 == 0
    return (
        chain.silver["lineitem"]
        .repartition(8)
        .withColumns(
            {key: F.when(hot, 1).otherwise(F.col(key)) for key in ("l_partkey", "l_suppkey")}
        )
        .withColumn("l_orderkey", F.when(hot, 2).otherwise(F.col("l_orderkey")))
    )


def test_hot_keys_of_sales_are_split(spark, chain, hot_lines):
    lines = gold.sales_lines(hot_lines, chain.gold["dim_product"], chain.gold["dim_supplier"])
    facts = gold.fact_sales(lines, chain.gold["fact_orders"])
    sums = [F.count("*"), F.sum("net_amount"), F.sum(F.col("product_key").cast("decimal(38,0)"))]
    want = facts.agg(*sums).first()
    with settings(spark, **SKEW):
        text = final_plan(facts.select("*"))
        have = facts.agg(*sums).first()
    assert len(re.findall(r"Join\(skew=true\)", text)) == 3
    assert have == want


def test_hot_foreign_key_is_split(spark, chain, hot_lines):
    with settings(spark, **SKEW):
        ok, bad = split_fk(hot_lines, chain.silver["part"], "l_partkey", "p_partkey")
        assert "Join(skew=true)" in final_plan(ok)
        assert "Join(skew=true)" in final_plan(bad)


def test_hot_year_is_written_by_several_tasks(spark, chain):
    one_year = (F.col("order_key") % 1 + 2000).cast("int")
    facts = chain.gold["fact_orders"].repartition(8, "order_key").withColumn("order_year", one_year)
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="10k"):
        spread = spread_for_write(facts, "order_year", "order_date_key")
        assert spread.rdd.getNumPartitions() > 1


def test_year_filter_prunes_files(spark, chain, tmp_path):
    write_layer(
        spread_for_write(chain.gold["fact_orders"], "order_year", "order_date_key"),
        str(tmp_path / "facts"),
        partition_by=["order_year"],
    )
    text = plan(read_layer(spark, str(tmp_path / "facts")).filter("order_year = 1996"))
    assert re.search(r"PartitionFilters: \[isnotnull\(order_year.*\(order_year#\d+ = 1996\)", text)


@pytest.mark.parametrize(
    "name", ["revenue_rollup", "status_pivot", "revenue_yoy", "revenue_ytd", "revenue_moving_3m"]
)
def test_reports_without_customers_do_not_read_or_shuffle_them(spark, small_dir, name):
    text = plan(QUERIES[name](spark, small_dir))
    assert "o_custkey" not in text and "c_custkey" not in text


def test_pareto_writes_nothing_and_cuts_every_region(spark, small_dir):
    text = plan(QUERIES["customer_pareto"](spark, small_dir))
    assert "Scan ExistingRDD" not in text
    assert "BroadcastHashJoin" in text and "_splitters" in text


def test_layer_counts_scan_each_table_twice(spark, small_dir):
    """Once as it came, once cleaned; which rows are orphans is not worked out."""
    text = plan(QUERIES["dq_layer_counts"](spark, small_dir))
    assert text.count("lineitem.parquet") == 2 and text.count("orders.parquet") == 2


def test_both_checks_of_cleaned_tables_read_them_once(chain):
    text = final_plan(quality.dq_cleaned(chain.bronze, chain.cleaned))
    counted = [line for line in text.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(counted) == 3 and sum("ReusedExchange" in line for line in counted) == 2
