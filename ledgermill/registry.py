"""Every query by name, each from the source tables to its result, writing nothing.

The queries chain the same layer functions as the load, in memory. Reports read
facts built from the typed source tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ledgermill.contracts import LINE_PAIR, SOURCE_TABLES
from ledgermill.functions.amounts import with_amounts
from ledgermill.operators.dedup import dedup_latest, exact_dedup
from ledgermill.operators.foreign_keys import split_fk
from ledgermill.plans import analytics, gold, quality
from ledgermill.plans.bronze import ingest, manifest
from ledgermill.plans.silver import (
    SILVER,
    clean_tables,
    latest_line_order,
    silver_geography,
)
from ledgermill.plans.sketches import order_value_spread
from ledgermill.sources.layers import read_source

Query = Callable[[SparkSession, str], DataFrame]

# The load time of a landed row is not part of what the bronze queries return.
_ANY_RUN = datetime(2000, 1, 1, tzinfo=timezone.utc)


class Tables(Mapping[str, DataFrame]):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


class Chain:
    """The layers of one source directory, in memory."""

    def __init__(self, spark: SparkSession, src_dir: str):
        self.bronze = Tables(
            {table: partial(read_source, spark, src_dir, table) for table in SOURCE_TABLES}
        )
        self.silver = Tables({table: partial(self._typed, table) for table in SOURCE_TABLES})
        self.gold = Tables(
            {
                "dim_date": lambda: gold.dim_date(
                    self.silver["orders"], self.silver["lineitem"]
                ),
                "dim_customer": lambda: gold.dim_customer(
                    self.silver["customer"], self.geography
                ),
                "dim_product": lambda: gold.dim_product(self.silver["part"]),
                "dim_supplier": lambda: gold.dim_supplier(
                    self.silver["supplier"], self.geography
                ),
                "fact_orders": lambda: gold.fact_orders(
                    self.silver["orders"], self.gold["dim_customer"]
                ),
                "order_headers": lambda: gold.order_headers(self.silver["orders"]),
                # Customers by their source key, which their surrogate key is.
                "order_facts": lambda: self.gold["order_headers"].withColumnRenamed(
                    "o_custkey", "customer_key"
                ),
                "dated_sales": lambda: gold.dated_sales(
                    self.gold["sales_lines"], self.gold["order_headers"]
                ),
                "sales_lines": lambda: gold.sales_lines(self.silver["lineitem"]),
                "fact_sales": lambda: gold.fact_sales(
                    self.gold["sales_lines"], self.gold["fact_orders"]
                ),
            }
        )

    def _typed(self, table: str) -> DataFrame:
        return SILVER[table](self.bronze[table])

    @property
    def cleaned(self) -> dict[str, DataFrame]:
        return clean_tables(self.silver)

    @property
    def geography(self) -> DataFrame:
        return silver_geography(self.silver["nation"], self.silver["region"])

    @property
    def fact_sales_looked_up(self) -> DataFrame:
        """Sales facts of lines whose part and supplier were not checked before."""
        lines = gold.sales_lines(
            self.silver["lineitem"], self.gold["dim_product"], self.gold["dim_supplier"]
        )
        return gold.fact_sales(lines, self.gold["fact_orders"])


def _bronze(table: str) -> Query:
    def query(spark: SparkSession, src_dir: str) -> DataFrame:
        landed = ingest(spark, src_dir, table, _ANY_RUN)
        return landed.drop("_source_file", "_ingested_at")

    return query


def _silver(table: str) -> Query:
    return lambda spark, src_dir: SILVER[table](read_source(spark, src_dir, table))


def _chained(build: Callable[[Chain], DataFrame]) -> Query:
    return lambda spark, src_dir: build(Chain(spark, src_dir))


def _orders_with_lines(chain: Chain) -> tuple[DataFrame, DataFrame]:
    """Orders split by whether they have a line; the fixtures have no orphans."""
    return split_fk(
        chain.silver["orders"],
        chain.silver["lineitem"],
        "o_orderkey",
        "l_orderkey",
        ref_is_unique=False,
    )


def _gold(table: str) -> Query:
    return _chained(lambda chain: chain.gold[table])


def _report(report: Callable[..., DataFrame], *tables: str) -> Query:
    return _chained(lambda chain: report(*(chain.gold[table] for table in tables)))


# Each report and the tables it is given. Ship dates and amounts are known from the
# lines alone, and order dates and totals from the orders alone, so reports that group by
# nothing else need no facts joined with orders or customers.
_REPORTS = (
    (analytics.revenue_monthly, "fact_sales", "dim_date"),
    (analytics.revenue_rollup, "order_headers", "dim_date"),
    (analytics.revenue_cube, "fact_sales"),
    (analytics.revenue_yoy, "dated_sales", "dim_date"),
    (analytics.revenue_ytd, "dated_sales", "dim_date"),
    (analytics.revenue_moving_3m, "dated_sales", "dim_date"),
    (analytics.top_customers, "fact_sales", "dim_date", "dim_customer"),
    (analytics.customer_pareto, "fact_orders", "dim_customer"),
    (analytics.customer_recency, "fact_orders", "dim_customer"),
    (analytics.gross_to_net, "sales_lines", "dim_date"),
    (analytics.status_pivot, "order_headers", "dim_date"),
    (order_value_spread, "order_facts", "dim_date"),
)


def _build() -> dict[str, Query]:
    queries: dict[str, Query] = {"bronze_ingest": _bronze("lineitem")}
    queries |= {
        f"bronze_ingest_{table}": _bronze(table)
        for table in SOURCE_TABLES
        if table != "lineitem"
    }
    queries["bronze_manifest"] = _chained(lambda c: manifest(c.bronze))
    queries |= {f"silver_{table}": _silver(table) for table in SOURCE_TABLES}

    chained: dict[str, Callable[[Chain], DataFrame]] = {
        "silver_geography": lambda c: c.geography,
        "silver_lineitem_amounts": lambda c: with_amounts(c.silver["lineitem"]),
        "silver_exact_dedup": lambda c: exact_dedup(c.silver["lineitem"]),
        "silver_dedup_latest": lambda c: dedup_latest(
            c.silver["lineitem"], LINE_PAIR, latest_line_order()
        ),
        "silver_fk_valid": lambda c: _orders_with_lines(c)[0],
        "silver_fk_quarantine": lambda c: _orders_with_lines(c)[1],
        "dq_not_null": lambda c: quality.dq_not_null(c.silver),
        "dq_unique": lambda c: quality.dq_unique(c.silver, c.gold),
        "dq_referential": lambda c: quality.dq_referential(c.silver),
        "dq_accepted_values": lambda c: quality.dq_accepted_values(c.silver),
        "dq_range": lambda c: quality.dq_range(c.silver),
        "dq_cross_column": lambda c: quality.dq_cross_column(c.silver),
        "dq_quarantine": lambda c: quality.dq_quarantine(c.cleaned),
        "dq_layer_counts": lambda c: quality.dq_layer_counts(c.bronze, c.cleaned),
        "dq_amount_recon": lambda c: quality.dq_amount_recon(c.silver),
        "dq_row_recon": lambda c: quality.dq_row_recon(c.silver, c.gold),
        "dq_date_coverage": lambda c: quality.dq_date_coverage(c.gold),
        "dq_summary": lambda c: quality.dq_summary(c.bronze, c.cleaned, c.silver, c.gold),
        "fact_sales": lambda c: c.fact_sales_looked_up,
    }
    queries |= {name: _chained(build) for name, build in chained.items()}
    queries |= {
        name: _gold(name)
        for name in ("dim_date", "dim_customer", "dim_product", "dim_supplier", "fact_orders")
    }
    return queries | {
        report.__name__: _report(report, *tables) for report, *tables in _REPORTS
    }


QUERIES = _build()
