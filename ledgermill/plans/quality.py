"""The checks of each layer, put together from the check operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.contracts import (
    ACCEPTED_VALUES,
    FOREIGN_KEYS,
    LINE_PAIR,
    PRIMARY_KEYS,
    QUARANTINE_SHARE,
    RANGES,
    RECON_TOLERANCE,
    REQUIRED,
)
from ledgermill.functions.amounts import with_amounts
from ledgermill.functions.keys import date_key, known_or_unknown, surrogate_key
from ledgermill.operators.checks import (
    ERROR,
    WARNING,
    Rule,
    accepted_values,
    amount_recon,
    date_coverage,
    in_range,
    layer_counts,
    not_null,
    references,
    row_recon,
    row_rules,
    rule_counts,
    rule_results,
    set_aside,
    set_aside_counts,
    set_aside_result,
    unique,
)
from ledgermill.operators.foreign_keys import OK
from ledgermill.operators.union import union_all
from ledgermill.plans.bronze import manifest
from ledgermill.plans.silver import ok_rows, placed_rows, source_row_counts

Tables = Mapping[str, DataFrame]

# Surrogate key of each dimension that has one.
SURROGATE_KEYS = {
    "dim_customer": "customer_key",
    "dim_product": "product_key",
    "dim_supplier": "supplier_key",
}

AMOUNTS = ("gross_amount", "discount_amount", "net_amount", "tax_amount", "total_amount")

DIMENSION_KEYS_OF_FACTS = {
    "fact_orders": ("order_date_key", "customer_key"),
    "fact_sales": (
        "order_date_key",
        "ship_date_key",
        "customer_key",
        "product_key",
        "supplier_key",
    ),
}


def not_null_rules(table: str, df: DataFrame) -> list[Rule]:
    return [
        not_null(table, column, ERROR if column in REQUIRED else WARNING)
        for column in df.columns
    ]


def accepted_value_rules(table: str) -> list[Rule]:
    return [
        accepted_values(table, column, values, ERROR)
        for (owner, column), values in ACCEPTED_VALUES.items()
        if owner == table
    ]


def range_rules(table: str) -> list[Rule]:
    return [
        in_range(table, rule.column, rule.low, rule.high, rule.severity)
        for rule in RANGES
        if rule.table == table
    ]


def _rules_per_table(
    silver: Tables, rules_of: Callable[[str, DataFrame], list[Rule]]
) -> DataFrame:
    ruled = ((table, df, rules_of(table, df)) for table, df in silver.items())
    return union_all(
        *(row_rules(df, "silver", table, rules) for table, df, rules in ruled if rules)
    )


def dq_not_null(silver: Tables) -> DataFrame:
    return _rules_per_table(silver, not_null_rules)


def dq_accepted_values(silver: Tables) -> DataFrame:
    return _rules_per_table(silver, lambda table, df: accepted_value_rules(table))


def dq_range(silver: Tables) -> DataFrame:
    return _rules_per_table(silver, lambda table, df: range_rules(table))


def silver_rules(table: str, df: DataFrame) -> list[Rule]:
    return [*not_null_rules(table, df), *accepted_value_rules(table), *range_rules(table)]


def dq_rows(silver: Tables) -> DataFrame:
    """The three checks above with one scan per table."""
    return _rules_per_table(silver, silver_rules)


def dq_unique_silver(silver: Tables) -> DataFrame:
    return union_all(
        *(
            unique(silver[table], "silver", table, [key], ERROR)
            for table, key in PRIMARY_KEYS.items()
        ),
        unique(silver["lineitem"], "silver", "lineitem", LINE_PAIR, WARNING),
    )


def dq_unique_gold(gold: Tables) -> DataFrame:
    """Every member of a dimension has a key of its own."""
    return union_all(
        *(
            unique(gold[table], "gold", table, [key], ERROR)
            for table, key in SURROGATE_KEYS.items()
        )
    )


def dq_unique(silver: Tables, gold: Tables) -> DataFrame:
    return union_all(dq_unique_silver(silver), dq_unique_gold(gold))


def dq_referential(silver: Tables, parents: Tables | None = None) -> DataFrame:
    """Warnings, because orphans of the facts are set aside before gold is built.

    ``parents`` are the tables that references must resolve in; ``silver`` by default.
    """
    parents = silver if parents is None else parents
    of: dict[str, list] = {}
    for ref in FOREIGN_KEYS:
        of.setdefault(ref.table, []).append((ref.fk, ref.ref_table, ref.pk, parents[ref.ref_table]))
    return union_all(
        *(references(silver[table], refs, "silver", table, WARNING) for table, refs in of.items())
    )


def dq_cross_column(silver: Tables) -> DataFrame:
    """Lines shipped before their order was placed."""
    dated = silver["lineitem"].select("l_orderkey", "l_shipdate").join(
        silver["orders"].select("o_orderkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"),
        "left",
    )
    early = Rule(
        "cross_column:lineitem.l_shipdate>=orders.o_orderdate",
        WARNING,
        F.col("l_shipdate") < F.col("o_orderdate"),
    )
    return row_rules(dated, "silver", "lineitem", [early])


def dq_layer_counts(bronze: Tables, cleaned: Tables) -> DataFrame:
    """Silver, quarantine and merged copies together are all of bronze."""
    return layer_counts(manifest(bronze), source_row_counts(cleaned), "silver")


def dq_quarantine(cleaned: Tables) -> DataFrame:
    """How much of each fact table's source was set aside."""
    return union_all(
        *(set_aside(cleaned[table], table, QUARANTINE_SHARE) for table in ("orders", "lineitem"))
    )


def dq_amount_recon(silver: Tables) -> DataFrame:
    return amount_recon(
        silver["orders"],
        with_amounts(silver["lineitem"]),
        "silver",
        "orders",
        "o_orderkey",
        "o_totalprice",
        "l_orderkey",
        "total_amount",
        RECON_TOLERANCE,
    )


def dq_row_recon(silver: Tables, gold: Tables) -> DataFrame:
    """Every silver order and line is in the facts once, with its keys, flags and amounts."""
    orders = silver["orders"].select(
        F.col("o_orderkey").alias("order_key"),
        date_key("o_orderdate").alias("order_date_key"),
        known_or_unknown(surrogate_key("o_custkey")).alias("customer_key"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"),
        F.col("o_totalprice").alias("order_total"),
    )
    lines = with_amounts(silver["lineitem"]).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        date_key("l_shipdate").alias("ship_date_key"),
        known_or_unknown(surrogate_key("l_partkey")).alias("product_key"),
        known_or_unknown(surrogate_key("l_suppkey")).alias("supplier_key"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_quantity").alias("quantity"),
        *AMOUNTS,
    )
    return union_all(
        row_recon(
            orders,
            gold["fact_orders"],
            "gold",
            "fact_orders",
            "row_recon:orders=fact_orders",
            key="order_key",
        ),
        row_recon(
            lines,
            gold["fact_sales"],
            "gold",
            "fact_sales",
            "row_recon:lineitem=fact_sales",
            key="order_key",
        ),
    )


def dq_date_coverage(gold: Tables) -> DataFrame:
    return date_coverage(
        gold["dim_date"], gold["fact_orders"], "gold", "fact_orders", "order_date_key"
    )


def dq_cleaned(bronze: Tables, cleaned: Tables) -> DataFrame:
    """``dq_layer_counts`` and ``dq_quarantine`` from one aggregate per cleaned table."""
    total, failed = set_aside_counts()
    counts = {
        table: df.agg(placed_rows().alias("n_rows"), total, failed)
        for table, df in cleaned.items()
    }
    # In one array, of which no part can be left out below the exchange: otherwise each check
    # reads a plan of its own, and tables are cleaned twice.
    named = (
        df.select(F.lit(table).alias("table_name"), F.array("n_rows", "total", "failed").alias("counts"))
        for table, df in counts.items()
    )
    # One row per table, exchanged once for both checks.
    rows = union_all(*named).repartition(2, "table_name")

    def of(table: str, place: int) -> Column:
        return F.max(F.when(F.col("table_name") == table, F.col("counts")[place]))

    return union_all(
        layer_counts(
            manifest(bronze), rows.select("table_name", F.col("counts")[0].alias("n_rows")), "silver"
        ),
        *(
            set_aside_result(
                rows.agg(of(table, 1).alias("total"), of(table, 2).alias("failed")),
                table,
                QUARANTINE_SHARE,
            )
            for table in ("orders", "lineitem")
        ),
    )


def dq_summary(bronze: Tables, cleaned: Tables, silver: Tables, gold: Tables) -> DataFrame:
    return union_all(
        dq_rows(silver),
        dq_unique(silver, gold),
        dq_referential(silver),
        dq_cross_column(silver),
        dq_cleaned(bronze, cleaned),
        dq_amount_recon(silver),
        dq_row_recon(silver, gold),
        dq_date_coverage(gold),
    )


# What is counted of a table while it is written, by name.
Counts = Mapping[str, Mapping[str, int]]


def landed_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows")]


def cleaned_counts(table: str, cleaned: DataFrame) -> list[Column]:
    """Rules on the rows that go on to gold, and source rows by where they went."""
    own = silver_rules(table, ok_rows(cleaned))
    total, failed = set_aside_counts()
    return [
        *rule_counts(own, F.col("row_status") == OK),
        total.alias("source_total"),
        failed.alias("source_failed"),
        placed_rows().alias("n_rows"),
    ]


def fact_rules(table: str) -> list[Rule]:
    """Rules on written facts.

    Order date and ship date are both in the sales facts, so comparing them needs no join.
    """
    keys = [not_null(table, key, ERROR) for key in DIMENSION_KEYS_OF_FACTS[table]]
    if table == "fact_orders":
        return [*keys, not_null(table, "order_total", ERROR)]
    early = Rule(
        "cross_column:fact_sales.ship_date_key>=order_date_key",
        WARNING,
        (F.col("ship_date_key") > 0) & (F.col("ship_date_key") < F.col("order_date_key")),
    )
    # A product that does not fit its decimal is null.
    return [*keys, *(not_null(table, column, ERROR) for column in AMOUNTS), early]


def _one_row(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    columns = ", ".join(f"`{name}` bigint" for name in counts)
    return spark.createDataFrame([tuple(counts.values())], columns)


def _row_counts(spark: SparkSession, counts: Counts) -> DataFrame:
    rows = [(table, seen["n_rows"] or 0) for table, seen in counts.items()]
    return spark.createDataFrame(rows, "table_name string, n_rows bigint")


def bronze_checks(source: Tables, landed: Counts) -> DataFrame:
    """Everything in the source was landed."""
    spark = next(iter(source.values())).sparkSession
    return layer_counts(manifest(source), _row_counts(spark, landed), "bronze")


def silver_checks(landed: Counts, cleaned: Tables, seen: Counts, silver: Tables) -> DataFrame:
    """Checks before the facts are built.

    Rules on rows and counts of rows come from what was counted while the tables were written.
    References of all rows, set aside or not, must resolve in the rows that go on to
    gold, so they fail where rows are set aside; the rest is checked on the rows that go on.
    """
    spark = next(iter(silver.values())).sparkSession
    of = {table: _one_row(spark, counts) for table, counts in seen.items()}
    ruled = (
        rule_results(of[table], "silver", table, silver_rules(table, df))
        for table, df in silver.items()
    )
    aside = (
        set_aside_result(
            of[table].select(
                F.col("source_total").alias("total"), F.col("source_failed").alias("failed")
            ),
            table,
            QUARANTINE_SHARE,
        )
        for table in ("orders", "lineitem")
    )
    return union_all(
        *ruled,
        dq_unique_silver(silver),
        dq_referential(cleaned, silver),
        *aside,
        layer_counts(_row_counts(spark, landed), _row_counts(spark, seen), "silver"),
        dq_amount_recon(silver),
    )


def gold_checks(silver: Tables, gold: Tables, seen: Counts) -> DataFrame:
    """Checks on written gold tables; rules on rows were counted while they were written."""
    spark = gold["fact_sales"].sparkSession
    return union_all(
        *(
            rule_results(_one_row(spark, seen[fact]), "gold", fact, fact_rules(fact))
            for fact in ("fact_sales", "fact_orders")
        ),
        dq_unique_gold(gold),
        dq_row_recon(silver, gold),
        dq_date_coverage(gold),
    )
