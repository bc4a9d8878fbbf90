"""Known numbers of the fixtures at sf0.01."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries

ROWS = {
    "silver_exact_dedup": 60_000,
    "silver_dedup_latest": 45_832,
    "silver_fk_valid": 14_743,
    "silver_fk_quarantine": 257,
    "dim_date": 2_557,
    "dim_customer": 1_501,
    "dim_product": 2_001,
    "dim_supplier": 101,
    "fact_sales": 60_000,
    "fact_orders": 15_000,
    "revenue_monthly": 397,
    "revenue_rollup": 35,
    "revenue_cube": 36,
    "revenue_yoy": 80,
    "revenue_ytd": 80,
    "revenue_moving_3m": 80,
    "top_customers": 70,
    "customer_pareto": 1_500,
    "customer_recency": 1_500,
    "gross_to_net": 21,
    "status_pivot": 7,
}


@pytest.mark.parametrize("name, count", ROWS.items())
def test_row_counts(spark, oracle_dir, name, count):
    assert queries()[name](spark, oracle_dir).count() == count


def test_check_results(spark, oracle_dir):
    rows = queries()["dq_summary"](spark, oracle_dir).collect()
    failed = {row.check_id: (row.failed, row.total) for row in rows if not row.passed}
    assert failed == {
        "range:customer.c_acctbal": (122, 1_500),
        "unique:lineitem.l_orderkey+l_linenumber": (14_168, 60_000),
        "cross_column:lineitem.l_shipdate>=orders.o_orderdate": (29_157, 60_000),
        "amount_recon:orders.o_totalprice": (14_743, 14_743),
        "date_coverage:fact_orders.order_date_key": (6, 2_405),
    }
    assert {row.severity for row in rows if not row.passed} == {"warning"}
    assert len({row.check_id for row in rows}) == len(rows)
