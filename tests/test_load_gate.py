"""Loads that must not be published."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgermill.contracts import SOURCE_TABLES
from ledgermill.operators.checks import DataQualityError
from ledgermill.plans.pipeline import run_pipeline

RUN_TS = datetime(2000, 1, 1, tzinfo=timezone.utc)


def _load(spark, small_dir, tmp_path, **changes):
    source = f"{tmp_path}/source"
    for table in SOURCE_TABLES:
        df = spark.read.parquet(f"{small_dir}/{table}.parquet")
        changes.get(table, lambda d: d)(df).write.parquet(f"{source}/{table}.parquet")
    return run_pipeline(spark, source, f"{tmp_path}/lake", RUN_TS)


def _failed(error):
    return str(error.value)


def test_missing_orders_stop_the_load(spark, small_dir, tmp_path):
    with pytest.raises(DataQualityError) as error:
        _load(spark, small_dir, tmp_path, orders=lambda d: d.where("o_orderkey <= 3"))
    assert "quarantine:lineitem" in _failed(error)


def test_missing_customers_are_reported_down_to_the_lines(spark, small_dir, tmp_path):
    def fewer(d):
        return d.where("c_custkey <> 7")

    orders = spark.read.parquet(f"{small_dir}/orders.parquet").where("o_custkey = 7")
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    lost = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_semi").count()
    checks = {r.check_id: r for r in _load(spark, small_dir, tmp_path, customer=fewer).collect()}
    assert 0 < lost <= 60
    assert checks["quarantine:lineitem"].failed == lost
    assert checks["quarantine:lineitem"].severity == "warning"
    reference = next(c for c in checks if "l_orderkey" in c and "orders" in c)
    assert checks[reference].failed == lost


def test_amounts_that_do_not_fit_stop_the_load(spark, small_dir, tmp_path):
    def dear(d):
        price = F.when(F.col("l_orderkey") == 1, F.lit(2e14)).otherwise(F.col("l_extendedprice"))
        return d.withColumn("l_extendedprice", price)

    with pytest.raises(DataQualityError) as error:
        _load(spark, small_dir, tmp_path, lineitem=dear)
    assert "net_amount" in _failed(error)


def test_far_days_stop_the_load_before_the_calendar(spark, small_dir, tmp_path):
    def far(d):
        day = F.when(F.col("l_orderkey") == 1, F.lit("9999-01-01").cast("timestamp_ntz"))
        return d.withColumn("l_shipdate", F.coalesce(day, "l_shipdate"))

    with pytest.raises(DataQualityError) as error:
        _load(spark, small_dir, tmp_path, lineitem=far)
    assert "l_shipdate" in _failed(error)
