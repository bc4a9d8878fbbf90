"""Loads only what changed: new and changed source files, and the years their rows are in.

Orders and lines are kept typed by the year of the order, each row with the file it is from.
When files come, change or go, the years that hold or held their rows are built anew, from
the rows kept of these years and the changed files. The facts of all other years stay where
they are. Monthly revenue is kept up by taking off what the old facts of those
years came to and adding what the new ones do.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermill.contracts import SILVER_DDL, SOURCE_TABLES, gold_schema
from ledgermill.functions.calendar import calendar_days, with_calendar_columns
from ledgermill.functions.keys import UNKNOWN_KEY
from ledgermill.operators.checks import ERROR, gate, unique
from ledgermill.operators.dedup import exact_dedup
from ledgermill.operators.union import union_all
from ledgermill.plans import gold, quality
from ledgermill.plans.analytics import revenue_monthly
from ledgermill.plans.silver import SILVER, clean_tables, ok_rows, silver_geography
from ledgermill.sources.layers import (
    read_layer,
    read_source,
    spread_for_write,
    write_layer,
)
from ledgermill.sources.versions import YEAR, YearlyTables

# Tables kept by year; the others are read whole.
YEARLY = ("orders", "lineitem")
FACTS = ("fact_orders", "fact_sales")
_FILE = "_file"
# What the facts take from the tables read whole, the source tables that it is from, and
# the column of the facts' sources that names it.
_KNOWN = {
    "customer": ("key bigint, market_segment string, region_name string", ("customer", "nation", "region")),
    "part": ("key bigint", ("part",)),
    "supplier": ("key bigint", ("supplier",)),
}
_KNOWN_BY = {
    "customer": ("orders", "o_custkey"),
    "part": ("lineitem", "l_partkey"),
    "supplier": ("lineitem", "l_suppkey"),
}


def _typed(table: str) -> StructType:
    return StructType.fromDDL(f"{SILVER_DDL[table]}, {_FILE} string, {YEAR} int")


def _monthly_schema() -> StructType:
    return StructType.fromDDL(
        "order_month int, market_segment string, net_revenue decimal(38,4), "
        f"tax decimal(38,6), line_count bigint, {YEAR} int"
    )


def source_files(spark: SparkSession, src_dir: str, table: str) -> DataFrame:
    """The files of a source table: name, path to read, size and time; none is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(f"{src_dir}/{table}.parquet")
    )
    return files.select(
        F.col("_metadata.file_path").alias("file"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def changed_files(lake: YearlyTables, src_dir: str, table: str) -> tuple[DataFrame, DataFrame]:
    """Files that are new or not as they were taken in, and files taken in that are gone.

    Both with the years that their rows were in, null for new ones.
    """
    found, known = source_files(lake.spark, src_dir, table), lake.files(table)
    changed = found.join(known, ["file", "size", "modified"], "left_anti")
    before = known.select("file", "years")
    return changed.join(before, "file", "left"), known.join(found, "file", "left_anti")


def load_changes(
    spark: SparkSession, src_dir: str, dst_dir: str, run_ts: datetime
) -> DataFrame:
    """Brings the tables below ``dst_dir`` up to the source; the years of the facts it wrote.

    Afterwards ``fact_orders``, ``fact_sales`` and ``revenue_monthly`` hold what a full load
    of the source would. A failed check of severity ``error`` on the rows of these years
    ends the run before it is committed. Without changes nothing is written. File names
    and years reach the driver, rows do not.
    """
    lake = YearlyTables(spark, dst_dir)
    change = _Change(lake, src_dir, run_ts)
    if change.any():
        change.build()
    years = [
        (fact, year) for fact in FACTS for year in sorted(change.written.get(fact, ((), ()))[1])
    ]
    return spark.createDataFrame(years, f"table_name string, {YEAR} int")


def read_table(spark: SparkSession, dst_dir: str, table: str) -> DataFrame:
    """``fact_orders``, ``fact_sales`` or ``revenue_monthly`` as the newest run left it."""
    lake = YearlyTables(spark, dst_dir)
    if table != "revenue_monthly":
        return lake.read(table, gold_schema(table))
    # Sales without a date are kept under the unknown key.
    dated = F.when(F.col(YEAR) != UNKNOWN_KEY, F.col(YEAR))
    return lake.read(table, _monthly_schema()).withColumn(YEAR, dated)


class _Change:
    """One run: what is new, changed or gone in the source, and the years it is in."""

    def __init__(self, lake: YearlyTables, src_dir: str, run_ts: datetime):
        self.lake, self.spark, self.src_dir = lake, lake.spark, src_dir
        self.sequence = lake.next_sequence()
        self.run_id = f"{run_ts:%Y%m%dT%H%M%S}-{self.sequence}"
        self.written: dict[str, tuple[set[int], set[int]]] = {}
        self.new: dict[str, list] = {}
        self.gone: dict[str, list] = {}
        for table in SOURCE_TABLES:
            changed, gone = changed_files(lake, src_dir, table)
            self.new[table], self.gone[table] = changed.collect(), gone.collect()

    def any(self) -> bool:
        return any(self.new.values()) or any(self.gone.values())

    def build(self) -> None:
        whole = {
            table: exact_dedup(SILVER[table](read_source(self.spark, self.src_dir, table)))
            for table in SOURCE_TABLES
            if table not in YEARLY
        }
        geography = silver_geography(whole["nation"], whole["region"])
        customers = self._keep(gold.dim_customer(whole["customer"], geography), "gold", "customer")

        fresh_orders = self._fresh("orders").withColumn(
            YEAR, F.coalesce(F.year("o_orderdate"), F.lit(UNKNOWN_KEY))
        )
        orders_now = self._left("orders").unionByName(fresh_orders)
        order_years = self._keep(_years_of_orders(orders_now), "keys", "orders")
        fresh_lines = _by_order_year(self._fresh("lineitem"), order_years)
        fresh = {"orders": fresh_orders, "lineitem": fresh_lines}
        years = {UNKNOWN_KEY} | self._years_before()
        for rows in (*fresh.values(), *self._rows_of_changed_members(whole, customers, fresh)):
            years |= {row[0] for row in rows.select(YEAR).distinct().collect()}

        self._write(self._left("orders", years).unionByName(fresh_orders), "orders", years)
        # An order that moved to another year takes its lines along, and one that came or went
        # finds or leaves lines without an order.
        lines = self._left("lineitem", years).drop(YEAR)
        lines = _by_order_year(lines, order_years).unionByName(fresh_lines)
        self._write(lines, "lineitem", years)

        self._build_facts(whole, customers, years)
        self.lake.commit(self.sequence, self.run_id, self._files(years), self.written)

    def _fresh(self, table: str) -> DataFrame:
        """Typed rows of the new and changed files, with their file."""
        paths = [row.path for row in self.new[table]]
        if not paths:
            return self.spark.createDataFrame([], _typed(table)).drop(YEAR)
        rows = self.spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias(_FILE))
        return SILVER[table](rows, _FILE)

    def _left(self, table: str, years: set[int] | None = None) -> DataFrame:
        """Rows taken in before, without those of files that changed or are gone."""
        rows = self.lake.read(table, _typed(table), years)
        over = [(row.file,) for row in (*self.new[table], *self.gone[table])]
        if not over:
            return rows
        files = self.spark.createDataFrame(over, f"{_FILE} string")
        return rows.join(files, _FILE, "left_anti").select(*_typed(table).names)

    def _years_before(self) -> set[int]:
        over = (row for t in YEARLY for row in (*self.new[t], *self.gone[t]))
        return {year for row in over for year in row.years or ()}

    def _rows_of_changed_members(
        self, whole: Mapping[str, DataFrame], customers: DataFrame, fresh: Mapping[str, DataFrame]
    ) -> Iterable[DataFrame]:
        """Orders and lines of customers, parts and suppliers that came, went or differ.

        Keeps those that are there now for the next run to compare with.
        """
        now = {
            "customer": customers.select(F.col("c_custkey").alias("key"), "market_segment", "region_name"),
            "part": whole["part"].select(F.col("p_partkey").alias("key")),
            "supplier": whole["supplier"].select(F.col("s_suppkey").alias("key")),
        }
        for member, (ddl, tables) in _KNOWN.items():
            if not any(self.new[t] or self.gone[t] for t in tables):
                continue
            name = f"known_{member}"
            schema = StructType.fromDDL(f"{ddl}, {YEAR} int")
            members = now[member].withColumn(YEAR, F.lit(0)).distinct()
            before = self.lake.read(name, schema)
            self._write(members, name, {0})
            after = self._written(name, schema)
            differ = before.subtract(after).union(after.subtract(before))
            keys = self._keep(differ.select("key").distinct(), "keys", member)
            table, column = _KNOWN_BY[member]
            rows = self._left(table).unionByName(fresh[table])
            yield rows.join(keys, rows[column] == keys["key"], "left_semi")

    def _build_facts(
        self, whole: Mapping[str, DataFrame], customers: DataFrame, years: set[int]
    ) -> None:
        """Cleans and checks the rows of ``years`` and writes their facts and monthly revenue."""
        typed = dict(whole)
        for table in YEARLY:
            typed[table] = self._written(table, _typed(table)).drop(_FILE, YEAR)
        cleaned = clean_tables({t: typed[t] for t in SOURCE_TABLES}, self._keep)
        silver = {table: ok_rows(df) for table, df in cleaned.items()}
        gate(
            self._keep(
                union_all(
                    quality.dq_rows(silver),
                    quality.dq_unique_silver(silver),
                    quality.dq_quarantine(cleaned),
                    self._orders_in_one_year(),
                ),
                "dq",
                "silver",
            )
        )
        self._write(gold.fact_orders(silver["orders"], customers), "fact_orders", years)
        orders = self._written("fact_orders", gold_schema("fact_orders"))
        sales = gold.fact_sales(gold.sales_lines(silver["lineitem"]), orders)
        self._write(sales, "fact_sales", years)

        before = self.lake.read("fact_sales", gold_schema("fact_sales"), years)
        after = self._written("fact_sales", gold_schema("fact_sales"))
        calendar = _calendar(self.spark, years)
        kept = self.lake.read("revenue_monthly", _monthly_schema(), years)
        monthly = _moved(kept, _monthly(before, calendar), _monthly(after, calendar))
        self._write(monthly, "revenue_monthly", years)

    def _orders_in_one_year(self) -> DataFrame:
        """Unlike rows of one order may stand in different years, each alone in its own."""
        pairs = read_layer(self.spark, self.lake.run_path(self.run_id, "keys_orders"))
        return unique(pairs, "silver", "orders in one year", ["o_orderkey"], ERROR)

    def _files(self, years: set[int]) -> DataFrame:
        """What is to be noted of files: all that came, changed or went, and all whose rows
        are in the rebuilt years or were."""
        frames = []
        for table in SOURCE_TABLES:
            new = [(r.file, r.size, r.modified, [], True) for r in self.new[table]]
            gone = [(r.file, r.size, r.modified, [], False) for r in self.gone[table]]
            ddl = "file string, size bigint, modified timestamp, years array<int>, kept boolean"
            noted = self.spark.createDataFrame(new + gone, ddl)
            if table in YEARLY:
                rebuilt = F.array(*map(F.lit, sorted(years)))
                others = self.lake.files(table).join(noted, "file", "left_anti")
                others = others.where(F.arrays_overlap("years", rebuilt)).select(
                    "file", "size", "modified", F.array_except("years", rebuilt).alias("years"), F.lit(True).alias("kept")
                )
                now = self._written(table, _typed(table)).groupBy(F.col(_FILE).alias("file"))
                now = now.agg(F.collect_set(YEAR).alias("now"))
                noted = noted.unionByName(others).join(now, "file", "left").withColumn(
                    "years", F.concat("years", F.coalesce("now", F.array().cast("array<int>")))
                )
            frames.append(noted.select(F.lit(table).alias("table_name"), "file", "size", "modified", "years", "kept"))
        return union_all(*frames)

    def _keep(self, df: DataFrame, layer: str, name: str) -> DataFrame:
        """Rows that only this run needs, written and read again."""
        path = self.lake.run_path(self.run_id, f"{layer}_{name}")
        write_layer(df, path)
        return read_layer(self.spark, path, df.schema)

    def _write(self, df: DataFrame, table: str, years: set[int]) -> None:
        path = self.lake.run_path(self.run_id, table)
        date = "order_date_key" if table in FACTS else YEAR
        write_layer(spread_for_write(df, YEAR, date), path, [YEAR])
        found = read_layer(self.spark, path, df.schema).select(YEAR).distinct()
        self.written[table] = (years, {row[0] for row in found.collect()})

    def _written(self, table: str, schema: StructType) -> DataFrame:
        return self.lake.read_run(self.run_id, table, schema, self.written[table][1])


def _years_of_orders(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", YEAR).where("o_orderkey is not null").distinct()


def _by_order_year(lines: DataFrame, order_years: DataFrame) -> DataFrame:
    """Lines with the year of their order, the unknown key where there is none.

    ``order_years`` is a written table with one row per order, so a hot order can be split.
    """
    years = order_years.withColumnRenamed("o_orderkey", "_key")
    joined = lines.join(years, lines["l_orderkey"] == years["_key"], "left").drop("_key")
    return joined.withColumn(YEAR, F.coalesce(YEAR, F.lit(UNKNOWN_KEY)))


def _calendar(spark: SparkSession, years: set[int]) -> DataFrame:
    dated = [year for year in years if year != UNKNOWN_KEY] or [1970]
    bounds = spark.range(1).select(
        F.make_date(F.lit(min(dated)), F.lit(1), F.lit(1)).alias("first_day"),
        F.make_date(F.lit(max(dated)), F.lit(12), F.lit(31)).alias("last_day"),
    )
    return with_calendar_columns(calendar_days(bounds))


def _monthly(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    monthly = revenue_monthly(sales, calendar)
    return monthly.withColumn(YEAR, F.coalesce(YEAR, F.lit(UNKNOWN_KEY))).select(*_monthly_schema().names)


def _moved(kept: DataFrame, off: DataFrame, on: DataFrame) -> DataFrame:
    """Monthly sums with those of some rows taken off and those of others added."""
    sums = ["net_revenue", "tax", "line_count"]
    signed = reduce(
        DataFrame.unionByName,
        (kept, off.withColumns({name: -F.col(name) for name in sums}), on),
    )
    moved = signed.groupBy(YEAR, "order_month", "market_segment").agg(
        *(F.sum(name).cast(_monthly_schema()[name].dataType).alias(name) for name in sums)
    )
    return moved.where("line_count <> 0").select(*_monthly_schema().names)
