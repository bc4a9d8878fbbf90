"""Silver: typed, trimmed, deduplicated rows, with orphans set aside."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.contracts import FOREIGN_KEYS
from ledgermill.functions.casts import day, key, money, rate, text, whole
from ledgermill.functions.keys import UNKNOWN_TEXT
from ledgermill.operators.dedup import exact_dedup
from ledgermill.operators.foreign_keys import OK, mark_orphans, orphan_keys
from ledgermill.operators.union import union_all


def silver_region(bronze: DataFrame) -> DataFrame:
    return bronze.select(key("r_regionkey"), text("r_name"))


def silver_nation(bronze: DataFrame) -> DataFrame:
    return bronze.select(key("n_nationkey"), text("n_name"), key("n_regionkey"))


def silver_customer(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        key("c_custkey"),
        text("c_name"),
        key("c_nationkey"),
        money("c_acctbal"),
        text("c_mktsegment"),
    )


def silver_supplier(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        key("s_suppkey"), text("s_name"), key("s_nationkey"), money("s_acctbal")
    )


def silver_part(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        key("p_partkey"),
        text("p_name"),
        text("p_brand"),
        text("p_type"),
        whole("p_size"),
        money("p_retailprice"),
    )


def silver_orders(bronze: DataFrame, *beside: str) -> DataFrame:
    return bronze.select(
        key("o_orderkey"),
        key("o_custkey"),
        text("o_orderstatus"),
        money("o_totalprice"),
        day("o_orderdate"),
        text("o_orderpriority"),
        *beside,
    )


def silver_lineitem(bronze: DataFrame, *beside: str) -> DataFrame:
    return bronze.select(
        key("l_orderkey"),
        key("l_partkey"),
        key("l_suppkey"),
        whole("l_linenumber"),
        money("l_quantity"),
        money("l_extendedprice"),
        rate("l_discount"),
        rate("l_tax"),
        text("l_returnflag"),
        text("l_linestatus"),
        day("l_shipdate"),
        *beside,
    )


SILVER: dict[str, Callable[..., DataFrame]] = {
    "region": silver_region,
    "nation": silver_nation,
    "customer": silver_customer,
    "supplier": silver_supplier,
    "part": silver_part,
    "orders": silver_orders,
    "lineitem": silver_lineitem,
}


def typed_tables(bronze: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {table: SILVER[table](df) for table, df in bronze.items()}


def silver_geography(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Nation with its region; a nation of no known region stays."""
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        "n_nationkey",
        "n_name",
        "r_regionkey",
        F.coalesce("r_name", F.lit(UNKNOWN_TEXT)).alias("r_name"),
    )


def latest_line_order() -> list[Column]:
    """Newest line first; every column that can differ breaks a tie."""
    return [
        F.desc("l_shipdate"),
        F.asc("l_partkey"),
        F.asc("l_suppkey"),
        F.asc("l_extendedprice"),
        F.asc("l_quantity"),
        F.asc("l_discount"),
        F.asc("l_tax"),
        F.asc("l_returnflag"),
        F.asc("l_linestatus"),
    ]


Keep = Callable[[DataFrame, str, str], DataFrame]


def as_planned(df: DataFrame, layer: str, name: str) -> DataFrame:
    """A ``Keep`` that writes nothing and goes on with the plan."""
    return df


def clean_tables(typed: Mapping[str, DataFrame], keep: Keep = as_planned) -> dict[str, DataFrame]:
    """Merges exact copies and marks rows whose foreign key is an orphan.

    ``keep(df, layer, name)`` is handed every result and returns the frame to go
    on with. A job that writes it and reads it back gives Spark the true size of
    the orphan keys, and each table is then shuffled once, for its copies.

    Lines of an order that was set aside are orphans too. ``lineitem`` is not
    reduced to one row per order and line number: those rows are different sales.
    """
    cleaned: dict[str, DataFrame] = {}
    for table, df in typed.items():
        orphans = {}
        for ref in FOREIGN_KEYS:
            if ref.table == table and ref.quarantines:
                missing = orphan_keys(df, ok_rows(cleaned[ref.ref_table]), ref.fk, ref.pk)
                orphans[ref.fk] = keep(missing, "orphans", f"{table}.{ref.fk}")
        marked = mark_orphans(exact_dedup(df, copies="source_rows"), orphans)
        cleaned[table] = keep(marked, "silver", table)
    return cleaned


def ok_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("row_status") == OK).drop(
        "source_rows", "reject_reason", "row_status"
    )


def placed_rows() -> Column:
    """The source rows that silver and quarantine together stand for.

    Every cleaned row is in one of the two, so its status is not looked at, and a query that
    counts need not work it out.
    """
    return F.coalesce(F.sum("source_rows"), F.lit(0))


def source_row_counts(cleaned: Mapping[str, DataFrame]) -> DataFrame:
    """Manifest of the source rows that silver and quarantine together stand for."""
    return union_all(
        *(
            df.agg(placed_rows().alias("n_rows")).select(
                F.lit(table).alias("table_name"), "n_rows"
            )
            for table, df in cleaned.items()
        )
    )
