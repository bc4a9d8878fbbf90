"""Layer writes and the whole load."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.testing import assertDataFrameEqual

from __spark_entry__ import queries
from ledgermill.contracts import GOLD_DDL, SOURCE_TABLES
from ledgermill.operators.checks import DataQualityError
from ledgermill.plans.pipeline import run_pipeline
from ledgermill.sources.layers import SchemaMismatch, read_layer, write_layer
from ledgermill.sources.runs import (
    NothingPublished,
    current_run,
    published_runs,
    read_gold,
    start_run,
)

RUN_TS = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
LATER = datetime(2024, 3, 2, 12, tzinfo=timezone.utc)


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_write_replaces_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_layer(spark.range(5), path)
    write_layer(spark.range(3), path)
    assert read_layer(spark, path).count() == 3


def test_write_replaces_partitions_no_longer_there(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1999), (2, 2000)], "a int, y int")
    write_layer(df, path, partition_by=["y"])
    write_layer(df.filter("y = 2000"), path, partition_by=["y"])
    assert rows(read_layer(spark, path)) == [(2, 2000)]


def test_write_of_given_partitions_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    write_layer(
        spark.createDataFrame([(1, 1999), (2, 2000)], "a int, y int"), path, partition_by=["y"]
    )
    fresh = spark.createDataFrame([(3, 2000)], "a int, y int")
    for _ in range(2):
        write_layer(fresh, path, partition_by=["y"], only_given_partitions=True)
    assert rows(read_layer(spark, path)) == [(1, 1999), (3, 2000)]


def test_write_checks_the_contract_first(spark, tmp_path):
    path = tmp_path / "t"
    with pytest.raises(SchemaMismatch, match="id is bigint, not int"):
        write_layer(spark.range(1), str(path), contract=StructType.fromDDL("id int"))
    assert not path.exists()


def test_empty_partitioned_table_reads_back(spark, tmp_path):
    path = str(tmp_path / "t")
    contract = StructType.fromDDL("a int, y int")
    write_layer(spark.createDataFrame([], contract), path, ["y"], contract)
    assert rows(read_layer(spark, path, contract)) == []


@pytest.fixture(scope="module")
def loaded(spark, small_dir, tmp_path_factory):
    dst = str(tmp_path_factory.mktemp("load"))
    first = run_pipeline(spark, small_dir, dst, RUN_TS)
    gold_once = {table: rows(read_gold(spark, dst, table)) for table in GOLD_DDL}
    run_pipeline(spark, small_dir, dst, RUN_TS)
    return dst, first, gold_once


def test_second_load_gives_the_same_rows_and_keys(spark, loaded):
    dst, _, gold_once = loaded
    assert published_runs(spark, dst).count() == 2
    assert current_run(spark, dst).run_id.endswith("-1")
    for table, before in gold_once.items():
        assert rows(read_gold(spark, dst, table)) == before


@pytest.mark.parametrize("table", sorted(GOLD_DDL))
def test_loaded_gold_equals_the_query(spark, loaded, small_dir, table):
    dst, _, _ = loaded
    stored = read_gold(spark, dst, table)
    assertDataFrameEqual(stored, queries()[table](spark, small_dir).select(*stored.columns))


def test_load_lands_bronze_unchanged_with_audit_columns(spark, loaded, small_dir):
    dst, _, _ = loaded
    landed = spark.read.parquet(current_run(spark, dst).path("bronze", "orders"))
    source = spark.read.parquet(f"{small_dir}/orders.parquet")
    assert rows(landed.select(source.columns)) == rows(source)
    audit = landed.select("_source_table", "_source_file", "_ingested_at").distinct().collect()
    assert [(a[0], a[1]) for a in audit] == [("orders", "orders.parquet")]


def test_load_returns_all_checks(loaded):
    _, results, _ = loaded
    failed = {row.check_id for row in results.filter("not passed").collect()}
    assert {row.layer for row in results.collect()} == {"bronze", "silver", "gold"}
    assert failed == {
        "range:customer.c_acctbal",
        "unique:lineitem.l_orderkey+l_linenumber",
        "amount_recon:orders.o_totalprice",
        "cross_column:fact_sales.ship_date_key>=order_date_key",
        # 1,500 orders cannot cover some 2,400 days.
        "date_coverage:fact_orders.order_date_key",
    }


def source_with(spark, small_dir, target: Path, changes) -> str:
    """A copy of the source tables with some of them changed."""
    for table in SOURCE_TABLES:
        df = spark.read.parquet(f"{small_dir}/{table}.parquet")
        changes.get(table, lambda same: same)(df).write.parquet(str(target / f"{table}.parquet"))
    return str(target)


def test_dirty_rows_are_merged_set_aside_or_unknown(spark, small_dir, tmp_path):
    def spoil_lines(df):
        copies = df.orderBy(*df.columns).limit(3)
        orphans = df.orderBy(*df.columns).limit(2).withColumn("l_partkey", F.lit(10**9))
        no_supplier = df.orderBy(*df.columns).limit(1).withColumn(
            "l_suppkey", F.lit(None).cast("bigint")
        )
        return df.unionAll(copies).unionAll(orphans).unionAll(no_supplier)

    def spoil_orders(df):
        orphan = df.orderBy("o_orderkey").limit(1).selectExpr(
            "cast(10000000 as bigint) o_orderkey", "cast(10000000 as bigint) o_custkey",
            "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        )
        return df.unionAll(orphan)

    src = source_with(
        spark, small_dir, tmp_path / "src", {"lineitem": spoil_lines, "orders": spoil_orders}
    )
    dst = str(tmp_path / "dst")
    results = {row.check_id: row for row in run_pipeline(spark, src, dst, RUN_TS).collect()}
    run = current_run(spark, dst)

    lines = spark.read.parquet(run.path("silver", "lineitem"))
    status = {row.row_status: row["count"] for row in lines.groupBy("row_status").count().collect()}
    assert status == {"ok": 6001, "quarantine": 2}
    assert lines.agg(F.sum("source_rows")).first()[0] == 6006
    bad = lines.filter("row_status = 'quarantine'")
    assert {row.reject_reason for row in bad.collect()} == {"l_partkey"}
    assert spark.read.parquet(run.path("silver", "orders")).filter(
        "row_status = 'quarantine'"
    ).count() == 1

    sales = read_gold(spark, dst, "fact_sales")
    assert sales.count() == 6001
    assert sales.filter("supplier_key = -1").count() == 1
    assert results["referential:lineitem.l_partkey->part.p_partkey"].failed == 2
    assert results["referential:orders.o_custkey->customer.c_custkey"].failed == 1
    assert results["layer_counts:lineitem"].passed
    assert results["row_recon:lineitem=fact_sales"].passed


def test_gate_stops_a_bad_load_and_leaves_the_last_good_one(spark, small_dir, tmp_path):
    dst = str(tmp_path / "dst")
    with pytest.raises(NothingPublished):
        read_gold(spark, dst, "dim_date")
    run_pipeline(spark, small_dir, dst, RUN_TS)
    good = rows(read_gold(spark, dst, "dim_customer"))

    def same_key_other_name(df):
        return df.unionAll(df.limit(1).withColumn("c_name", F.lit("Other")))

    src = source_with(
        spark, small_dir, tmp_path / "src", {"customer": same_key_other_name}
    )
    with pytest.raises(DataQualityError, match="unique:customer.c_custkey"):
        run_pipeline(spark, src, dst, LATER)
    assert rows(read_gold(spark, dst, "dim_customer")) == good
    assert published_runs(spark, dst).count() == 1

    failed = start_run(spark, dst, LATER)
    checks = spark.read.parquet(failed.path("dq", "silver"))
    assert not checks.filter("check_id = 'unique:customer.c_custkey'").first().passed
    assert not Path(failed.path("gold", "dim_customer")).exists()

    run_pipeline(spark, small_dir, dst, LATER)
    assert current_run(spark, dst).run_id == failed.run_id
