"""The whole load as one Spark application: source, bronze, silver, gold, published."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ledgermill.contracts import (
    SOURCE_TABLES,
    cleaned_schema,
    geography_schema,
    gold_schema,
)
from ledgermill.operators.checks import gate, rule_counts
from ledgermill.operators.union import union_all
from ledgermill.plans import gold, quality
from ledgermill.plans.bronze import ingest, source_tables
from ledgermill.plans.silver import clean_tables, ok_rows, silver_geography, typed_tables
from ledgermill.sources.bucketed import write_bucketed
from ledgermill.sources.layers import check_contract, read_layer, spread_for_write, write_layer
from ledgermill.sources.runs import Run, publish, start_run

Counts = dict[str, int]


# Tables that are joined and summed by the order, and their column for it.
ORDER_KEY = {"orders": "o_orderkey", "lineitem": "l_orderkey", "fact_orders": "order_key"}


def run_pipeline(
    spark: SparkSession,
    src_dir: str,
    dst_dir: str,
    run_ts: datetime,
    order_buckets: int | None = None,
) -> DataFrame:
    """Loads all source tables and returns the results of all checks.

    Each layer is written, read back and checked before the next is built. A
    failed check of severity ``error`` ends the run, which is then not published;
    its check results stay below the run's path. Every stage reads written
    tables, so a lost executor costs the tasks it ran and no earlier stage.
    ``run_ts`` should carry its time zone.

    With ``order_buckets``, orders, their lines and their facts are written in that many
    buckets by order, and neither joining lines with orders nor summing lines per order
    shuffles them again; a bucket should be what a task can hold. No order may then
    have a large share of all lines, since one order is one task's.
    """
    run = start_run(spark, dst_dir, run_ts)
    source = source_tables(spark, src_dir)

    bronze, landed = {}, {}
    for table in SOURCE_TABLES:
        rows = ingest(spark, src_dir, table, run_ts)
        bronze[table], landed[table] = _store_counted(
            rows, quality.landed_counts(), run, "bronze", table
        )
    results = [_check(quality.bronze_checks(source, landed), run, "bronze")]

    seen: dict[str, Counts] = {}

    def keep(df: DataFrame, layer: str, name: str) -> DataFrame:
        if layer != "silver":
            return _store(df, run, layer, name)
        how = {"partition_by": ["row_status"], "contract": cleaned_schema(name)}
        how["buckets"] = order_buckets if name in ORDER_KEY else None
        counts = quality.cleaned_counts(name, df)
        written, seen[name] = _store_counted(df, counts, run, layer, name, **how)
        return written

    cleaned = clean_tables(typed_tables(bronze), keep)
    silver = {table: ok_rows(df) for table, df in cleaned.items()}
    results.append(_check(quality.silver_checks(landed, cleaned, seen, silver), run, "silver"))

    published, counted = _build_gold(silver, run, order_buckets)
    results.append(_check(quality.gold_checks(silver, published, counted), run, "gold"))

    publish(spark, run)
    return union_all(*results)


def _build_gold(
    silver: dict[str, DataFrame], run: Run, order_buckets: int | None
) -> tuple[dict[str, DataFrame], dict[str, Counts]]:
    """The written gold tables, and what was counted of the facts on the way."""
    geography = _store(
        silver_geography(silver["nation"], silver["region"]),
        run,
        "silver",
        "geography",
        contract=geography_schema(),
    )
    dimensions = {
        "dim_date": gold.dim_date(silver["orders"], silver["lineitem"]),
        "dim_customer": gold.dim_customer(silver["customer"], geography),
        "dim_product": gold.dim_product(silver["part"]),
        "dim_supplier": gold.dim_supplier(silver["supplier"], geography),
    }
    tables = {
        name: _store(df, run, "gold", name, contract=gold_schema(name))
        for name, df in dimensions.items()
    }
    counted: dict[str, Counts] = {}
    orders = gold.fact_orders(silver["orders"], tables["dim_customer"])
    tables["fact_orders"], counted["fact_orders"] = _store_fact(
        orders, run, "fact_orders", order_buckets
    )
    # Silver has set lines of unknown parts and suppliers aside.
    sales = gold.fact_sales(gold.sales_lines(silver["lineitem"]), tables["fact_orders"])
    tables["fact_sales"], counted["fact_sales"] = _store_fact(sales, run, "fact_sales")
    return tables, counted


def _store_fact(
    df: DataFrame, run: Run, name: str, buckets: int | None = None
) -> tuple[DataFrame, Counts]:
    spread = df if buckets else spread_for_write(df, "order_year", "order_date_key")
    how = {"partition_by": ["order_year"], "contract": gold_schema(name), "buckets": buckets}
    return _store_counted(spread, rule_counts(quality.fact_rules(name)), run, "gold", name, **how)


def _store(
    df: DataFrame, run: Run, layer: str, name: str, buckets: int | None = None, **how
) -> DataFrame:
    path = run.path(layer, name)
    if buckets:
        check_contract(df, path, how["contract"])
        table = write_bucketed(df, path, ORDER_KEY[name], buckets, how["partition_by"])
        return table.select(*how["contract"].names)
    write_layer(df, path, **how)
    return read_layer(df.sparkSession, path, how.get("contract"))


def _store_counted(
    df: DataFrame, counts: list[Column], run: Run, layer: str, name: str, **how
) -> tuple[DataFrame, Counts]:
    """The written table, and ``counts`` of its rows, taken by the tasks that write it.

    They are counted last before the write, in its result tasks, of which Spark counts each
    once even if it runs again; with buckets, before the rows are dealt to them.
    """
    seen = Observation(f"{layer}.{name}")
    written = _store(df.observe(seen, *counts), run, layer, name, **how)
    return written, seen.get


def _check(checks: DataFrame, run: Run, layer: str) -> DataFrame:
    results = _store(checks, run, "dq", layer)
    gate(results)
    return results
