"""Loading only what changed, against a full load of the same source."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from ledgermill.contracts import SOURCE_TABLES
from ledgermill.operators.checks import DataQualityError
from ledgermill.plans import analytics
from ledgermill.plans.incremental import FACTS, load_changes, read_table
from ledgermill.registry import Chain
from ledgermill.sources.versions import YearlyTables

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def by_year(table: pa.Table, years: pa.Array, folder: Path) -> None:
    folder.mkdir(parents=True)
    for year in pc.unique(years).to_pylist():
        pq.write_table(table.filter(pc.equal(years, year)), folder / f"y {year}.parquet")


@pytest.fixture
def source(small_dir, tmp_path):
    """The small tables, orders and lines with a file per year of the order."""
    src = tmp_path / "src"
    orders = pq.read_table(f"{small_dir}/orders.parquet")
    years = pc.year(orders["o_orderdate"])
    by_year(orders, years, src / "orders.parquet")
    lines = pq.read_table(f"{small_dir}/lineitem.parquet")
    of_order = dict(zip(orders["o_orderkey"].to_pylist(), years.to_pylist(), strict=True))
    line_years = pa.array([of_order[k] for k in lines["l_orderkey"].to_pylist()])
    by_year(lines, line_years, src / "lineitem.parquet")
    for table in SOURCE_TABLES[:-2]:
        pq.write_table(pq.read_table(f"{small_dir}/{table}.parquet"), src / f"{table}.parquet")
    return src


def changed(path: Path, column: str, change, rows: int) -> None:
    """Rewrites a file with ``change`` applied to a column of its first rows."""
    table = pq.read_table(path)
    values = table[column].to_pylist()
    values[:rows] = [change(v) for v in values[:rows]]
    at = table.schema.get_field_index(column)
    pq.write_table(table.set_column(at, table.field(at), pa.array(values, table.field(at).type)), path)


def rows(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=str)


def assert_like_a_full_load(spark, source, dst):
    """The source has neither copies nor orphans, so the whole chain in memory is the load."""
    chain = Chain(spark, str(source))
    for fact in FACTS:
        assert rows(read_table(spark, dst, fact)) == rows(chain.gold[fact])
    monthly = analytics.revenue_monthly(chain.gold["fact_sales"], chain.gold["dim_date"])
    assert rows(read_table(spark, dst, "revenue_monthly")) == rows(monthly)


def test_changes_give_what_a_full_load_gives(spark, source, tmp_path):
    dst = str(tmp_path / "lake")
    steps = iter(range(99))

    def load():
        ts = START + timedelta(days=next(steps))
        touched = load_changes(spark, str(source), dst, ts)
        return {(r.table_name, r.order_year) for r in touched.collect()}

    def versions():
        return {fact: YearlyTables(spark, dst).versions(fact) for fact in FACTS}

    first = load()
    assert {year for _, year in first} == set(range(1995, 2002))
    assert_like_a_full_load(spark, source, dst)
    before = versions()

    assert load() == set()
    assert versions() == before

    # Other discounts in one file: that year alone is written.
    changed(source / "lineitem.parquet" / "y 1997.parquet", "l_discount", lambda d: 0.05, 40)
    assert load() == {(fact, 1997) for fact in FACTS}
    after = versions()
    for fact in FACTS:
        differ = {y for y in before[fact] if before[fact][y] != after[fact][y]}
        assert differ == {1997}
    assert_like_a_full_load(spark, source, dst)

    # Orders that move to another year, whose lines stand in files that did not change, a
    # customer of another segment, and a year that goes.
    changed(
        source / "orders.parquet" / "y 1996.parquet", "o_orderdate", lambda d: d.replace(year=1999, day=1), 5
    )
    for table in ("orders", "lineitem"):
        (source / f"{table}.parquet" / "y 1995.parquet").unlink()
    assert {year for _, year in load()} == {1996, 1999}
    assert set(versions()["fact_sales"]) == set(range(1996, 2002))
    assert_like_a_full_load(spark, source, dst)

    changed(source / "customer.parquet", "c_mktsegment", lambda s: "MACHINERY", 1)
    # Lines of the moved orders: their file was noted under the year that they moved to.
    changed(source / "lineitem.parquet" / "y 1996.parquet", "l_quantity", lambda q: 1.0, 10**6)
    assert {1996, 1999} <= {year for _, year in load()}
    assert_like_a_full_load(spark, source, dst)


def test_a_bad_change_is_not_committed(spark, source, tmp_path):
    dst = str(tmp_path / "lake")
    load_changes(spark, str(source), dst, START)
    good = rows(read_table(spark, dst, "fact_orders"))

    changed(source / "orders.parquet" / "y 1998.parquet", "o_totalprice", lambda p: None, 3)
    with pytest.raises(DataQualityError, match="not_null:orders.o_totalprice"):
        load_changes(spark, str(source), dst, START + timedelta(days=1))
    assert rows(read_table(spark, dst, "fact_orders")) == good

    # The same order in two years.
    changed(source / "orders.parquet" / "y 1998.parquet", "o_totalprice", lambda p: 1.0, 3)
    one = pq.read_table(source / "orders.parquet" / "y 1999.parquet").slice(0, 1)
    at = one.schema.get_field_index("o_orderdate")
    moved = pa.array([d.replace(year=2000, day=1) for d in one["o_orderdate"].to_pylist()], one.field(at).type)
    pq.write_table(one.set_column(at, one.field(at), moved), source / "orders.parquet" / "again.parquet")
    with pytest.raises(DataQualityError, match="orders in one year"):
        load_changes(spark, str(source), dst, START + timedelta(days=2))
    (source / "orders.parquet" / "again.parquet").unlink()
    load_changes(spark, str(source), dst, START + timedelta(days=3))
    assert rows(read_table(spark, dst, "fact_orders")) != good
