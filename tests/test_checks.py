"""Every check on data that breaks it, and the gate."""

from __future__ import annotations

import random
import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermill.operators import checks
from ledgermill.operators.union import union_all
from ledgermill.registry import Chain


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    row = rows[0]
    assert df.schema.simpleString() == StructType.fromDDL(checks.RESULT_DDL).simpleString()
    assert row.passed == (row.failed == 0)
    return row.total, row.failed


def test_not_null(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "a int")
    result = checks.row_rules(df, "silver", "t", [checks.not_null("t", "a", "error")])
    assert only(result) == (3, 2)


def test_accepted_values_leaves_null_to_the_null_check(spark):
    df = spark.createDataFrame([("A",), ("X",), (None,)], "a string")
    rule = checks.accepted_values("t", "a", ["A", "B"], "error")
    assert only(checks.row_rules(df, "silver", "t", [rule])) == (3, 1)


@pytest.mark.parametrize(
    "low, high, failed", [("1", "2", 2), (None, "2", 1), ("1", None, 1), (None, None, 0)]
)
def test_range_bounds_are_inclusive(spark, low, high, failed):
    values = ["0.99", "1.00", "2.00", "2.01", None]
    df = spark.createDataFrame([(v and Decimal(v),) for v in values], "a decimal(18,2)")
    low, high = (edge and Decimal(edge) for edge in (low, high))
    rule = checks.in_range("t", "a", low, high, "error")
    assert only(checks.row_rules(df, "silver", "t", [rule])) == (5, failed)


def test_rules_of_a_table_share_one_scan(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/orders.parquet")
    rules = [checks.not_null("orders", column, "error") for column in df.columns]
    result = checks.row_rules(df, "silver", "orders", rules)
    assert result.count() == len(rules)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_rules_on_no_rows(spark):
    df = spark.createDataFrame([], "a int")
    result = checks.row_rules(df, "silver", "t", [checks.not_null("t", "a", "error")])
    assert only(result) == (0, 0)


def test_unique(spark):
    df = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 1), (1, 2), (2, 1), (None, 1), (None, 1)], "a int, b int"
    )
    assert only(checks.unique(df, "silver", "t", ["a", "b"], "error")) == (5, 2)
    assert only(checks.unique(df.limit(0), "silver", "t", ["a"], "error")) == (0, 0)


def test_referential(spark):
    df = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "fk int")
    ref = spark.createDataFrame([(1,), (2,)], "pk int")
    result = checks.referential(df, ref, "silver", "t", "r", "fk", "pk", "error")
    assert only(result) == (4, 2)
    assert result.first().check_id == "referential:t.fk->r.pk"


def test_references_of_a_table_share_one_scan_and_equal_each_alone(spark, small_dir):
    df = spark.createDataFrame(
        [(1, 7), (1, None), (9, 8), (9, 8), (None, 7)], "a int, b bigint"
    ).withColumn("c", F.lit(None).cast("bigint"))
    ref = spark.createDataFrame([(1,), (7,)], "pk bigint")
    refs = [("a", "r", "pk", ref), ("b", "r", "pk", ref), ("c", "r", "pk", ref)]
    result = checks.references(df, refs, "silver", "t", "error")
    alone = union_all(
        *(checks.referential(df, ref, "silver", "t", "r", fk, "pk", "error") for fk in "abc")
    )
    assert sorted(result.collect()) == sorted(alone.collect())
    assert {(r.total, r.failed) for r in result.collect()} == {(4, 2), (0, 0)}
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    few = [(fk, "r", "pk", ref) for fk in ("l_orderkey", "l_partkey")]
    plan = checks.references(lines, few, "silver", "t", "error")._jdf.queryExecution()
    assert plan.executedPlan().toString().count("FileScan parquet") == 1


def test_cross_column(spark):
    df = spark.createDataFrame(
        [(date(2000, 1, 1), date(2000, 1, 2)), (date(2000, 1, 3), date(2000, 1, 2)), (None, None)],
        "ordered date, shipped date",
    )
    rule = checks.Rule("cross_column:t", "warning", F.col("shipped") < F.col("ordered"))
    assert only(checks.row_rules(df, "silver", "t", [rule])) == (3, 1)


def test_layer_counts(spark):
    want = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "table_name string, n_rows bigint")
    have = spark.createDataFrame([("a", 5), ("b", 7), ("d", 1)], "table_name string, n_rows bigint")
    rows = checks.layer_counts(want, have, "silver").collect()
    assert {(r.table_name, r.total, r.failed) for r in rows} == {
        ("a", 5, 0),
        ("b", 5, 2),
        ("c", 5, 5),
        ("d", 0, 1),
    }


@pytest.mark.parametrize("seed", range(4))
def test_row_recon_equals_except_all_both_ways(spark, seed):
    rng = random.Random(seed)

    def some_rows():
        return [(rng.choice([1, 2, 3, None]), rng.choice(["a", None])) for _ in range(30)]

    left = spark.createDataFrame(some_rows(), "a int, b string")
    right = spark.createDataFrame(some_rows(), "a int, b string")
    off = left.exceptAll(right).count() + right.exceptAll(left).count()
    assert only(checks.row_recon(left, right, "gold", "t", "row_recon:t")) == (30, off)
    assert only(checks.row_recon(left, left, "gold", "t", "row_recon:t")) == (30, 0)


def test_row_recon_counts_each_change_of_a_column(spark, small_dir):
    chain = Chain(spark, small_dir)
    lines = chain.gold["sales_lines"]
    n, key = lines.count(), lines.first().order_key
    line = lines.where(F.col("order_key") == key).agg(F.min("line_number")).first()[0]
    one = (F.col("order_key") == key) & (F.col("line_number") == line)
    for column, value in (
        ("net_amount", F.col("net_amount") + Decimal("0.01")),
        ("discount_amount", F.lit(None)),
        ("return_flag", F.lit("X")),
        ("supplier_key", F.lit(-1)),
        ("order_key", F.lit(10**12)),
    ):
        spoiled = lines.withColumn(column, F.when(one, value.cast(lines.schema[column].dataType)).otherwise(F.col(column)))
        wrong = spoiled.exceptAll(lines).count()
        assert wrong >= 1
        result = checks.row_recon(lines, spoiled, "gold", "t", "row_recon:t", key="order_key")
        assert only(result) == (n, 2 * wrong)
    lost = lines.where(~one)
    result = checks.row_recon(lines, lost, "gold", "t", "row_recon:t", key="order_key")
    assert only(result) == (n, n - lost.count())


def test_row_recon_of_equal_sides_shuffles_no_rows(spark, small_dir):
    lines = Chain(spark, small_dir).gold["sales_lines"]
    result = checks.row_recon(lines, lines.repartition(5), "gold", "t", "row_recon:t", key="order_key")
    result.collect()
    text = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Nothing is exchanged by hash any more: no bucket differs, so no rows are left to compare.
    assert "hashpartitioning" not in text


def test_amount_recon(spark):
    headers = spark.createDataFrame(
        [(1, Decimal("10.00")), (2, Decimal("10.00")), (3, Decimal("1.00")), (4, Decimal("10.99"))],
        "h bigint, total decimal(18,2)",
    )
    lines = spark.createDataFrame(
        [(1, Decimal("4.00")), (1, Decimal("6.00")), (2, Decimal("9.00")), (4, Decimal("10.00"))],
        "l bigint, amount decimal(18,2)",
    )
    result = checks.amount_recon(
        headers, lines, "silver", "t", "h", "total", "l", "amount", Decimal("1.00")
    )
    assert only(result) == (3, 1)


def test_date_coverage_counts_between_first_and_last(spark):
    days = spark.createDataFrame([(d,) for d in range(20000101, 20000111)], "date_key int")
    facts = spark.createDataFrame([(20000103,), (20000103,), (20000106,), (-1,)], "d int")
    assert only(checks.date_coverage(days, facts, "gold", "t", "d")) == (4, 2)


def test_schema_problems(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert checks.schema_problems(df, StructType.fromDDL("a int, b string")) == []
    assert "a is int, not bigint" in checks.schema_problems(
        df, StructType.fromDDL("a bigint, b string")
    )
    assert checks.schema_problems(df, StructType.fromDDL("b string, a int"))
    assert checks.schema_problems(df, StructType.fromDDL("a int"))


def test_gate_stops_on_errors_only(spark):
    df = spark.createDataFrame([(None,)], "a int")
    warned = checks.row_rules(df, "silver", "t", [checks.not_null("t", "a", "warning")])
    checks.gate(warned)
    failed = checks.row_rules(df, "silver", "t", [checks.not_null("t", "a", "error")])
    with pytest.raises(checks.DataQualityError, match=r"not_null:t.a \(1 of 1\)"):
        checks.gate(union_all(warned, failed))


def test_rows_that_differ_by_which_of_many_columns_is_null(spark):
    names = [f"c{i}" for i in range(40)]
    ddl = ", ".join(f"{name} int" for name in ["k", *names])
    rows = [(1, *(None if i == at else 5 for i in range(40))) for at in (2, 3, 35, 36)]
    for a in rows:
        for b in rows[:2]:
            left, right = spark.createDataFrame([a], ddl), spark.createDataFrame([b], ddl)
            assert checks.row_recon(left, right, "gold", "t", "id").first().failed == (0 if a == b else 2)
