from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from ledgermill.functions import casts
from ledgermill.functions.amounts import with_amounts
from ledgermill.functions.audit import with_audit
from ledgermill.functions.calendar import calendar_days, with_calendar_columns
from ledgermill.functions.keys import (
    UNKNOWN_KEY,
    date_key,
    date_of_key,
    known_or_unknown,
    surrogate_key,
    with_unknown_member,
)


def test_casts_turn_what_does_not_fit_into_null(spark):
    df = spark.createDataFrame(
        [
            ("12", 1.5, " a "),
            ("x", float("nan"), None),
            (None, float("inf"), ""),
            ("3", 1e30, "b"),
        ],
        "k string, m double, t string",
    )
    rows = df.select(casts.key("k"), casts.money("m"), casts.text("t")).collect()
    assert [row.k for row in rows] == [12, None, None, 3]
    assert [row.m for row in rows] == [Decimal("1.50"), None, None, None]
    assert [row.t for row in rows] == ["a", None, "", "b"]


def test_day_of_text(spark):
    df = spark.createDataFrame([("1996-02-29",), ("1995-02-29",), ("soon",)], "d string")
    assert [row.d for row in df.select(casts.day("d")).collect()] == [
        date(1996, 2, 29),
        None,
        None,
    ]


def test_surrogate_key_is_one_to_one_and_null_without_key(spark):
    df = spark.createDataFrame([(k,) for k in (0, 1, 2**62, 2**63 - 1, None)], "id bigint")
    rows = df.select(
        "id", surrogate_key("id").alias("key"), known_or_unknown(surrogate_key("id")).alias("known")
    ).collect()
    assert all(row.key == row.id for row in rows)
    assert rows[-1].known == UNKNOWN_KEY


def test_date_keys_there_and_back(spark):
    days = [date(1996, 2, 29), date(1995, 1, 1), date(2001, 12, 31), None]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", date_key("d").alias("k"))
    rows = df.select("d", "k", date_of_key(F.col("k")).alias("back")).collect()
    assert [row.k for row in rows] == [19960229, 19950101, 20011231, -1]
    assert [row.back for row in rows] == days


def test_unknown_member_leaves_other_columns_null(spark):
    schema = "k bigint, t string, m decimal(18,2)"
    df = spark.createDataFrame([(5, "five", Decimal("1.00"))], schema)
    rows = with_unknown_member(df, k=UNKNOWN_KEY, t="Unknown").orderBy("k").collect()
    assert [tuple(row) for row in rows] == [(-1, "Unknown", None), (5, "five", Decimal("1.00"))]


def test_calendar(spark):
    bounds = spark.createDataFrame(
        [(date(1995, 1, 1), date(1996, 12, 31))], "first_day date, last_day date"
    )
    days = {row.date: row for row in with_calendar_columns(calendar_days(bounds)).collect()}
    assert len(days) == 365 + 366

    edge = days[date(1995, 1, 1)]
    assert (edge.iso_year, edge.iso_week, edge.iso_weekday) == (1994, 52, 7)
    assert (edge.day_name, edge.is_weekend, edge.is_month_end) == ("Sunday", True, False)

    leap = days[date(1996, 2, 29)]
    assert (leap.date_key, leap.day_of_year, leap.is_month_end) == (19960229, 60, True)
    assert (leap.quarter, leap.month_name, leap.is_weekend) == (1, "February", False)
    assert not days[date(1996, 2, 28)].is_month_end


def test_amounts_are_exact(spark):
    df = spark.createDataFrame(
        [
            (Decimal("19.99"), Decimal("0.07"), Decimal("0.08")),
            (Decimal("100.00"), Decimal("0.00"), Decimal("0.00")),
            (None, Decimal("0.07"), Decimal("0.08")),
        ],
        "l_extendedprice decimal(18,2), l_discount decimal(5,2), l_tax decimal(5,2)",
    )
    odd, plain, missing = with_amounts(df).collect()
    assert odd.gross_amount == Decimal("19.99")
    assert odd.discount_amount == Decimal("1.3993")
    assert odd.net_amount == Decimal("18.5907")
    assert odd.tax_amount == Decimal("1.487256")
    assert odd.total_amount == Decimal("20.077956")
    assert plain.total_amount == Decimal("100")
    assert missing.net_amount is None and missing.total_amount is None


def test_amount_that_does_not_fit_is_null(spark):
    df = spark.createDataFrame(
        [(Decimal("9999999999999999.99"), Decimal("0.00"), Decimal("0.00"))],
        "l_extendedprice decimal(18,2), l_discount decimal(5,2), l_tax decimal(5,2)",
    )
    assert with_amounts(df).first().net_amount is None


def test_audit_columns(spark, small_dir):
    run_ts = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
    landed = with_audit(spark.read.parquet(f"{small_dir}/region.parquet"), "region", run_ts)
    rows = landed.select(
        "_source_table", "_source_file", F.col("_ingested_at").cast("string").alias("at")
    ).distinct()
    assert [tuple(row) for row in rows.collect()] == [
        ("region", "region.parquet", "2024-03-01 12:00:00")
    ]
