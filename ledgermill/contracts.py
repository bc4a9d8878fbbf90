"""What the tables must look like: schemas, keys, references and value rules."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql.types import StructType

from ledgermill.operators.checks import ERROR, WARNING

# Parents come before the tables that refer to them.
SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

SILVER_DDL = {
    "region": "r_regionkey bigint, r_name string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal decimal(18,2), "
        "c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal decimal(18,2)",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice decimal(18,2)"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice decimal(18,2), o_orderdate date, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity decimal(18,2), l_extendedprice decimal(18,2), l_discount decimal(5,2), "
        "l_tax decimal(5,2), l_returnflag string, l_linestatus string, l_shipdate date"
    ),
}

GEOGRAPHY_DDL = "n_nationkey bigint, n_name string, r_regionkey bigint, r_name string"

# Columns the cleaning step adds to each silver table.
CLEANING_DDL = "source_rows bigint, reject_reason string, row_status string"

GOLD_DDL = {
    "dim_date": (
        "date_key int, date date, year int, quarter int, month int, month_name string, "
        "day int, iso_weekday int, day_name string, iso_week int, iso_year int, "
        "day_of_year int, is_weekend boolean, is_month_end boolean"
    ),
    "dim_customer": (
        "customer_key bigint, c_custkey bigint, customer_name string, market_segment string, "
        "account_balance decimal(18,2), nation_name string, region_name string"
    ),
    "dim_product": (
        "product_key bigint, p_partkey bigint, product_name string, brand string, "
        "product_type string, size int, retail_price decimal(18,2)"
    ),
    "dim_supplier": (
        "supplier_key bigint, s_suppkey bigint, supplier_name string, "
        "account_balance decimal(18,2), nation_name string, region_name string"
    ),
    "fact_orders": (
        "order_key bigint, order_date_key int, customer_key bigint, market_segment string, "
        "region_name string, order_status string, order_priority string, "
        "order_total decimal(18,2), order_year int"
    ),
    "fact_sales": (
        "order_key bigint, line_number int, order_date_key int, ship_date_key int, "
        "customer_key bigint, product_key bigint, supplier_key bigint, "
        "market_segment string, region_name string, return_flag string, line_status string, "
        "quantity decimal(18,2), gross_amount decimal(18,2), discount_amount decimal(18,4), "
        "net_amount decimal(18,4), tax_amount decimal(18,6), total_amount decimal(18,6), "
        "order_year int"
    ),
}


def silver_schema(table: str) -> StructType:
    return StructType.fromDDL(SILVER_DDL[table])


def cleaned_schema(table: str) -> StructType:
    return StructType.fromDDL(f"{SILVER_DDL[table]}, {CLEANING_DDL}")


def geography_schema() -> StructType:
    return StructType.fromDDL(GEOGRAPHY_DDL)


def gold_schema(table: str) -> StructType:
    return StructType.fromDDL(GOLD_DDL[table])


class ForeignKey(NamedTuple):
    table: str
    fk: str
    ref_table: str
    pk: str
    # Fact rows with an orphan key are set aside. A customer or supplier whose
    # nation is not known stays, with an unknown nation.
    quarantines: bool


PRIMARY_KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
}

# Looks like the key of lineitem, and is not one: reported as a warning.
LINE_PAIR = ("l_orderkey", "l_linenumber")

FOREIGN_KEYS = (
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey", False),
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey", False),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey", False),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey", True),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", True),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey", True),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey", True),
)

# A null here makes published numbers wrong; in any other column it is a warning.
REQUIRED = {
    "r_regionkey",
    "n_nationkey",
    "c_custkey",
    "s_suppkey",
    "p_partkey",
    "o_orderkey",
    "o_totalprice",
    "o_orderdate",
    "l_orderkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_shipdate",
}

# The codes found in the source tables.
ACCEPTED_VALUES = {
    ("customer", "c_mktsegment"): (
        "AUTOMOBILE",
        "BUILDING",
        "FURNITURE",
        "HOUSEHOLD",
        "MACHINERY",
    ),
    ("part", "p_type"): ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    ("orders", "o_orderstatus"): ("F", "O", "P"),
    ("orders", "o_orderpriority"): (
        "1-URGENT",
        "2-HIGH",
        "3-MEDIUM",
        "4-NOT SPECIFIED",
        "5-LOW",
    ),
    ("lineitem", "l_returnflag"): ("A", "N", "R"),
    ("lineitem", "l_linestatus"): ("F", "O"),
}


class Range(NamedTuple):
    table: str
    column: str
    low: Decimal | date | None
    high: Decimal | date | None
    severity: str


# Days outside these are typing errors, and would stretch the calendar.
FIRST_DAY, LAST_DAY = date(1970, 1, 1), date(2099, 12, 31)

RANGES = (
    Range("customer", "c_acctbal", Decimal("0"), None, WARNING),
    # Keys of dimensions are these keys, and -1 is the unknown member.
    Range("customer", "c_custkey", Decimal("0"), None, ERROR),
    Range("supplier", "s_suppkey", Decimal("0"), None, ERROR),
    Range("part", "p_partkey", Decimal("0"), None, ERROR),
    Range("orders", "o_orderdate", FIRST_DAY, LAST_DAY, ERROR),
    Range("lineitem", "l_shipdate", FIRST_DAY, LAST_DAY, ERROR),
    Range("lineitem", "l_quantity", Decimal("1"), Decimal("50"), ERROR),
    Range("lineitem", "l_discount", Decimal("0.00"), Decimal("0.10"), ERROR),
    Range("lineitem", "l_tax", Decimal("0.00"), Decimal("0.08"), ERROR),
)

# A larger share of a fact table's rows set aside stops the load.
QUARANTINE_SHARE = 0.01

# A header total this far off the sum of its lines is reported.
RECON_TOLERANCE = Decimal("1.00")
