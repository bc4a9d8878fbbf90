"""The queries of the registry as ANSI SQL over the source tables.

Written from the definition of each query and not from its Spark plan, so that
the two can be held against each other. Spark never runs these.
"""

from __future__ import annotations

_SILVER = {
    "region": (
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, trim(r_name) AS r_name FROM region"
    ),
    "nation": (
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, trim(n_name) AS n_name, "
        "CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
    ),
    "customer": """
        SELECT c_custkey, trim(c_name) AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
            CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, trim(c_mktsegment) AS c_mktsegment
        FROM customer""",
    "supplier": """
        SELECT s_suppkey, trim(s_name) AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey,
            CAST(s_acctbal AS DECIMAL(18,2)) AS s_acctbal
        FROM supplier""",
    "part": """
        SELECT p_partkey, trim(p_name) AS p_name, trim(p_brand) AS p_brand,
            trim(p_type) AS p_type, p_size,
            CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice
        FROM part""",
    "orders": """
        SELECT o_orderkey, o_custkey, trim(o_orderstatus) AS o_orderstatus,
            CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
            CAST(o_orderdate AS DATE) AS o_orderdate, trim(o_orderpriority) AS o_orderpriority
        FROM orders""",
    "lineitem": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
            CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity,
            CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice,
            CAST(l_discount AS DECIMAL(5,2)) AS l_discount,
            CAST(l_tax AS DECIMAL(5,2)) AS l_tax,
            trim(l_returnflag) AS l_returnflag, trim(l_linestatus) AS l_linestatus,
            CAST(l_shipdate AS DATE) AS l_shipdate
        FROM lineitem""",
}

# Silver and gold tables as common table expressions, each after those it uses.
_CTES = {
    **{f"s_{table}": sql for table, sql in _SILVER.items()},
    "amounts": """
        SELECT *, CAST(net_amount + tax_amount AS DECIMAL(18,6)) AS total_amount
        FROM (
            SELECT *, CAST(net_amount * l_tax AS DECIMAL(18,6)) AS tax_amount
            FROM (
                SELECT *, l_extendedprice AS gross_amount,
                    CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS discount_amount,
                    CAST(l_extendedprice * (CAST(1 AS DECIMAL(5,2)) - l_discount)
                        AS DECIMAL(18,4)) AS net_amount
                FROM s_lineitem
            )
        )""",
    "geography": """
        SELECT n_nationkey, n_name, r_regionkey, coalesce(r_name, 'Unknown') AS r_name
        FROM s_nation LEFT JOIN s_region ON n_regionkey = r_regionkey""",
    "dim_date": """
        SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date,
            CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
            CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name,
            CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) AS INTEGER) AS iso_weekday,
            dayname(date) AS day_name, CAST(weekofyear(date) AS INTEGER) AS iso_week,
            CAST(isoyear(date) AS INTEGER) AS iso_year,
            CAST(dayofyear(date) AS INTEGER) AS day_of_year,
            isodow(date) >= 6 AS is_weekend, date = last_day(date) AS is_month_end
        FROM (
            SELECT CAST(unnest(generate_series(
                make_date(year(min(d)), 1, 1), make_date(year(max(d)), 12, 31),
                INTERVAL 1 DAY)) AS DATE) AS date
            FROM (
                SELECT o_orderdate AS d FROM s_orders
                UNION ALL SELECT l_shipdate FROM s_lineitem
            )
        )""",
    "dim_customer": """
        SELECT CAST(c_custkey AS BIGINT)
                AS customer_key,
            c_custkey, c_name AS customer_name,
            coalesce(c_mktsegment, 'Unknown') AS market_segment, c_acctbal AS account_balance,
            coalesce(n_name, 'Unknown') AS nation_name,
            coalesce(r_name, 'Unknown') AS region_name
        FROM s_customer LEFT JOIN geography ON c_nationkey = n_nationkey
        UNION ALL
        SELECT -1, NULL, 'Unknown', 'Unknown', NULL, 'Unknown', 'Unknown'""",
    "dim_product": """
        SELECT CAST(p_partkey AS BIGINT) AS product_key,
            p_partkey, p_name AS product_name, p_brand AS brand, p_type AS product_type,
            p_size AS size, p_retailprice AS retail_price
        FROM s_part
        UNION ALL
        SELECT -1, NULL, 'Unknown', 'Unknown', 'Unknown', NULL, NULL""",
    "dim_supplier": """
        SELECT CAST(s_suppkey AS BIGINT)
                AS supplier_key,
            s_suppkey, s_name AS supplier_name, s_acctbal AS account_balance,
            coalesce(n_name, 'Unknown') AS nation_name,
            coalesce(r_name, 'Unknown') AS region_name
        FROM s_supplier LEFT JOIN geography ON s_nationkey = n_nationkey
        UNION ALL
        SELECT -1, NULL, 'Unknown', NULL, 'Unknown', 'Unknown'""",
    "fact_orders": """
        SELECT o_orderkey AS order_key,
            CAST(coalesce(CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER), -1) AS INTEGER)
                AS order_date_key,
            CAST(coalesce(customer_key, -1) AS BIGINT) AS customer_key,
            coalesce(market_segment, 'Unknown') AS market_segment,
            coalesce(region_name, 'Unknown') AS region_name,
            o_orderstatus AS order_status, o_orderpriority AS order_priority,
            o_totalprice AS order_total,
            CAST(coalesce(year(o_orderdate), -1) AS INTEGER) AS order_year
        FROM s_orders LEFT JOIN dim_customer ON o_custkey = c_custkey""",
    "fact_sales": """
        SELECT l_orderkey AS order_key, l_linenumber AS line_number,
            CAST(coalesce(order_date_key, -1) AS INTEGER) AS order_date_key,
            CAST(coalesce(CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER), -1) AS INTEGER)
                AS ship_date_key,
            CAST(coalesce(customer_key, -1) AS BIGINT) AS customer_key,
            CAST(coalesce(product_key, -1) AS BIGINT) AS product_key,
            CAST(coalesce(supplier_key, -1) AS BIGINT) AS supplier_key,
            coalesce(market_segment, 'Unknown') AS market_segment,
            coalesce(fact_orders.region_name, 'Unknown') AS region_name,
            l_returnflag AS return_flag, l_linestatus AS line_status, l_quantity AS quantity,
            gross_amount, discount_amount, net_amount, tax_amount, total_amount,
            CAST(coalesce(order_year, -1) AS INTEGER) AS order_year
        FROM amounts
        LEFT JOIN fact_orders ON l_orderkey = order_key
        LEFT JOIN dim_product ON l_partkey = p_partkey
        LEFT JOIN dim_supplier ON l_suppkey = s_suppkey""",
    "monthly": """
        SELECT year AS order_year, month AS order_month,
            CAST(sum(net_amount) AS DECIMAL(38,4)) AS net_revenue
        FROM fact_sales LEFT JOIN dim_date ON order_date_key = date_key
        GROUP BY year, month""",
}


def _with_layers(select: str) -> str:
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in _CTES.items())
    return f"WITH {ctes} {select}"


def _check(
    check_id: str, layer: str, table: str, severity: str, total: str, failed: str, source: str
) -> str:
    return f"""
        SELECT '{check_id}' AS check_id, '{layer}' AS layer, '{table}' AS table_name,
            '{severity}' AS severity, CAST(coalesce({total}, 0) AS BIGINT) AS total,
            CAST(coalesce({failed}, 0) AS BIGINT) AS failed,
            CAST(coalesce({failed}, 0) AS BIGINT) = 0 AS passed
        FROM {source}"""


def _rule(check_id: str, table: str, severity: str, broken: str, source: str = "") -> str:
    return _check(
        check_id,
        "silver",
        table,
        severity,
        "count(*)",
        f"count(*) FILTER (WHERE {broken})",
        source or f"s_{table}",
    )


_REQUIRED = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_totalprice", "o_orderdate"],
    "lineitem": [
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_shipdate",
    ],
}
_OPTIONAL = {
    "region": ["r_name"],
    "nation": ["n_name", "n_regionkey"],
    "customer": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"],
}

_NOT_NULL = [
    _rule(f"not_null:{table}.{column}", table, severity, f"{column} IS NULL")
    for severity, columns_of in (("error", _REQUIRED), ("warning", _OPTIONAL))
    for table, columns in columns_of.items()
    for column in columns
]

_ACCEPTED = [
    _rule(f"accepted_values:{table}.{column}", table, "error", f"{column} NOT IN ({values})")
    for table, column, values in (
        (
            "customer",
            "c_mktsegment",
            "'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'",
        ),
        ("part", "p_type", "'ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'"),
        ("orders", "o_orderstatus", "'F', 'O', 'P'"),
        (
            "orders",
            "o_orderpriority",
            "'1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'",
        ),
        ("lineitem", "l_returnflag", "'A', 'N', 'R'"),
        ("lineitem", "l_linestatus", "'F', 'O'"),
    )
]

_DAYS = "BETWEEN DATE '1970-01-01' AND DATE '2099-12-31'"

_RANGE = [
    _rule(f"range:{table}.{column}", table, severity, broken)
    for table, column, severity, broken in (
        ("customer", "c_acctbal", "warning", "c_acctbal < 0"),
        ("customer", "c_custkey", "error", "c_custkey < 0"),
        ("supplier", "s_suppkey", "error", "s_suppkey < 0"),
        ("part", "p_partkey", "error", "p_partkey < 0"),
        ("orders", "o_orderdate", "error", f"o_orderdate NOT {_DAYS}"),
        ("lineitem", "l_shipdate", "error", f"l_shipdate NOT {_DAYS}"),
        ("lineitem", "l_quantity", "error", "l_quantity NOT BETWEEN 1 AND 50"),
        ("lineitem", "l_discount", "error", "l_discount NOT BETWEEN 0.00 AND 0.10"),
        ("lineitem", "l_tax", "error", "l_tax NOT BETWEEN 0.00 AND 0.08"),
    )
]

_UNIQUE = [
    _check(
        f"unique:{table}.{keys.replace(', ', '+')}",
        layer,
        table,
        severity,
        "sum(n)",
        "sum(n - 1)",
        f"(SELECT count(*) AS n FROM {source} "
        f"WHERE {' AND '.join(f'{key} IS NOT NULL' for key in keys.split(', '))} "
        f"GROUP BY {keys})",
    )
    for layer, table, source, keys, severity in (
        ("silver", "region", "s_region", "r_regionkey", "error"),
        ("silver", "nation", "s_nation", "n_nationkey", "error"),
        ("silver", "customer", "s_customer", "c_custkey", "error"),
        ("silver", "supplier", "s_supplier", "s_suppkey", "error"),
        ("silver", "part", "s_part", "p_partkey", "error"),
        ("silver", "orders", "s_orders", "o_orderkey", "error"),
        ("silver", "lineitem", "s_lineitem", "l_orderkey, l_linenumber", "warning"),
        ("gold", "dim_customer", "dim_customer", "customer_key", "error"),
        ("gold", "dim_product", "dim_product", "product_key", "error"),
        ("gold", "dim_supplier", "dim_supplier", "supplier_key", "error"),
    )
]

_REFERENTIAL = [
    _check(
        f"referential:{table}.{fk}->{ref}.{pk}",
        "silver",
        table,
        "warning",
        f"(SELECT count({fk}) FROM s_{table})",
        f"(SELECT count({fk}) FROM s_{table} WHERE NOT EXISTS "
        f"(SELECT 1 FROM s_{ref} WHERE {pk} = {fk}))",
        "(SELECT 1)",
    )
    for table, fk, ref, pk in (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    )
]

_CROSS_COLUMN = [
    _rule(
        "cross_column:lineitem.l_shipdate>=orders.o_orderdate",
        "lineitem",
        "warning",
        "l_shipdate < o_orderdate",
        "s_lineitem LEFT JOIN s_orders ON l_orderkey = o_orderkey",
    )
]

# What each row of silver and quarantine stands for, counted back to bronze.
_KEPT_OR_SET_ASIDE = {
    table: f"SELECT sum(n) FROM (SELECT count(*) AS n FROM s_{table} GROUP BY ALL)"
    for table in ("region", "nation", "customer", "supplier", "part")
} | {
    "orders": """
        SELECT (SELECT count(*) FROM s_orders
                WHERE o_custkey IS NULL OR o_custkey IN (SELECT c_custkey FROM s_customer))
            + (SELECT count(*) FROM s_orders WHERE o_custkey IS NOT NULL
                AND o_custkey NOT IN (SELECT c_custkey FROM s_customer))""",
    # The rows kept and the rows set aside, each found and merged on its own.
    "lineitem": """
        SELECT (SELECT coalesce(sum(n), 0) FROM (
                SELECT count(*) AS n FROM s_lineitem
                LEFT JOIN (SELECT DISTINCT o_orderkey FROM s_orders) ON l_orderkey = o_orderkey
                LEFT JOIN (SELECT DISTINCT p_partkey FROM s_part) ON l_partkey = p_partkey
                LEFT JOIN (SELECT DISTINCT s_suppkey FROM s_supplier) ON l_suppkey = s_suppkey
                WHERE (l_orderkey IS NULL OR o_orderkey IS NOT NULL)
                    AND (l_partkey IS NULL OR p_partkey IS NOT NULL)
                    AND (l_suppkey IS NULL OR s_suppkey IS NOT NULL)
                GROUP BY ALL))
            + (SELECT coalesce(sum(n), 0) FROM (
                SELECT count(*) AS n FROM s_lineitem
                WHERE l_orderkey NOT IN (SELECT o_orderkey FROM s_orders)
                    OR l_partkey NOT IN (SELECT p_partkey FROM s_part)
                    OR l_suppkey NOT IN (SELECT s_suppkey FROM s_supplier)
                GROUP BY ALL))""",
}

_LAYER_COUNTS = [
    _check(
        f"layer_counts:{table}",
        "silver",
        table,
        "error",
        "want",
        "abs(have - want)",
        f"(SELECT (SELECT count(*) FROM {table}) AS want, ({have}) AS have)",
    )
    for table, have in _KEPT_OR_SET_ASIDE.items()
]

_AMOUNT_RECON = [
    _check(
        "amount_recon:orders.o_totalprice",
        "silver",
        "orders",
        "warning",
        "count(*)",
        "count(*) FILTER (WHERE abs(o_totalprice - line_sum) >= 1.00)",
        "s_orders JOIN (SELECT l_orderkey, sum(total_amount) AS line_sum FROM amounts "
        "GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    )
]


def _both_ways(left: str, right: str) -> str:
    return (
        f"(SELECT (SELECT count(*) FROM ({left})) AS n, "
        f"(SELECT count(*) FROM ({left} EXCEPT ALL {right})) "
        f"+ (SELECT count(*) FROM ({right} EXCEPT ALL {left})) AS off)"
    )


_ROW_RECON = [
    _check(
        "row_recon:orders=fact_orders",
        "gold",
        "fact_orders",
        "error",
        "n",
        "off",
        _both_ways(
            "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER), o_custkey, "
            "o_orderstatus, o_orderpriority, o_totalprice FROM s_orders",
            "SELECT order_key, order_date_key, customer_key, order_status, order_priority, "
            "order_total FROM fact_orders",
        ),
    ),
    _check(
        "row_recon:lineitem=fact_sales",
        "gold",
        "fact_sales",
        "error",
        "n",
        "off",
        _both_ways(
            "SELECT l_orderkey, l_linenumber, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER), "
            "l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, gross_amount, "
            "discount_amount, net_amount, tax_amount, total_amount FROM amounts",
            "SELECT order_key, line_number, ship_date_key, product_key, supplier_key, "
            "return_flag, line_status, quantity, gross_amount, discount_amount, net_amount, "
            "tax_amount, total_amount FROM fact_sales",
        ),
    ),
]

_DATE_COVERAGE = [
    _check(
        "date_coverage:fact_orders.order_date_key",
        "gold",
        "fact_orders",
        "warning",
        "count(*)",
        "count(*) FILTER (WHERE date NOT IN (SELECT o_orderdate FROM s_orders "
        "WHERE o_orderdate IS NOT NULL))",
        "(SELECT date FROM dim_date WHERE date BETWEEN (SELECT min(o_orderdate) FROM s_orders) "
        "AND (SELECT max(o_orderdate) FROM s_orders))",
    )
]

_QUARANTINE = [
    f"""
        SELECT 'quarantine:{table}' AS check_id, 'silver' AS layer, '{table}' AS table_name,
            CASE WHEN count(*) FILTER (WHERE {away}) > 0.01 * count(*) THEN 'error'
                ELSE 'warning' END AS severity,
            CAST(count(*) AS BIGINT) AS total,
            CAST(count(*) FILTER (WHERE {away}) AS BIGINT) AS failed,
            count(*) FILTER (WHERE {away}) = 0 AS passed
        FROM s_{table}"""
    for table, away in (
        ("orders", "o_custkey NOT IN (SELECT c_custkey FROM s_customer)"),
        (
            "lineitem",
            "l_orderkey NOT IN (SELECT o_orderkey FROM s_orders WHERE o_custkey IS NULL "
            "OR o_custkey IN (SELECT c_custkey FROM s_customer)) "
            "OR l_partkey NOT IN (SELECT p_partkey FROM s_part) "
            "OR l_suppkey NOT IN (SELECT s_suppkey FROM s_supplier)",
        ),
    )
]

_CHECKS = {
    "dq_quarantine": _QUARANTINE,
    "dq_not_null": _NOT_NULL,
    "dq_unique": _UNIQUE,
    "dq_referential": _REFERENTIAL,
    "dq_accepted_values": _ACCEPTED,
    "dq_range": _RANGE,
    "dq_cross_column": _CROSS_COLUMN,
    "dq_layer_counts": _LAYER_COUNTS,
    "dq_amount_recon": _AMOUNT_RECON,
    "dq_row_recon": _ROW_RECON,
    "dq_date_coverage": _DATE_COVERAGE,
}

_LATEST_LINE = """
    SELECT * EXCLUDE (position) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity,
                l_discount, l_tax, l_returnflag, l_linestatus
        ) AS position
        FROM s_lineitem
    ) WHERE position = 1"""

_REPORTS = {
    "revenue_monthly": """
        SELECT year AS order_year, month AS order_month, market_segment,
            CAST(sum(net_amount) AS DECIMAL(38,4)) AS net_revenue,
            CAST(sum(tax_amount) AS DECIMAL(38,6)) AS tax, count(*) AS line_count
        FROM fact_sales LEFT JOIN dim_date ON order_date_key = date_key
        GROUP BY year, month, market_segment""",
    "order_value_spread": """
        SELECT year AS order_year, count(o_totalprice) AS order_count,
            min(o_totalprice) AS least_total, max(o_totalprice) AS greatest_total
        FROM s_orders LEFT JOIN dim_date ON o_orderdate = date
        GROUP BY year""",
    "revenue_rollup": """
        SELECT year AS order_year, quarter AS order_quarter,
            CAST(sum(order_total) AS DECIMAL(38,2)) AS order_total, count(*) AS order_count,
            CAST(grouping(year, quarter) AS INTEGER) AS subtotal_level
        FROM fact_orders LEFT JOIN dim_date ON order_date_key = date_key
        GROUP BY ROLLUP (year, quarter)""",
    "revenue_cube": """
        SELECT region_name, market_segment,
            CAST(sum(net_amount) AS DECIMAL(38,4)) AS net_revenue,
            CAST(grouping(region_name, market_segment) AS INTEGER) AS subtotal_level
        FROM fact_sales GROUP BY CUBE (region_name, market_segment)""",
    "revenue_yoy": """
        SELECT this.order_year, this.order_month, this.net_revenue,
            before.net_revenue AS prior_year_revenue,
            round(CAST(this.net_revenue - before.net_revenue AS DOUBLE)
                / nullif(CAST(before.net_revenue AS DOUBLE), 0), 6) AS growth
        FROM monthly AS this LEFT JOIN monthly AS before
            ON before.order_year = this.order_year - 1
            AND before.order_month = this.order_month""",
    "revenue_ytd": """
        SELECT this.order_year, this.order_month, this.net_revenue,
            CAST(sum(so_far.net_revenue) AS DECIMAL(38,4)) AS ytd_revenue
        FROM monthly AS this JOIN monthly AS so_far
            ON so_far.order_year = this.order_year
            AND so_far.order_month <= this.order_month
        GROUP BY this.order_year, this.order_month, this.net_revenue""",
    "revenue_moving_3m": """
        SELECT this.order_year, this.order_month, this.net_revenue,
            CAST(sum(near.net_revenue) AS DECIMAL(38,4)) AS moving_sum,
            round(CAST(sum(near.net_revenue) AS DOUBLE) / count(*), 4) AS moving_average
        FROM monthly AS this JOIN monthly AS near
            ON near.order_year * 12 + near.order_month
            BETWEEN this.order_year * 12 + this.order_month - 2
            AND this.order_year * 12 + this.order_month
        GROUP BY this.order_year, this.order_month, this.net_revenue""",
    "top_customers": """
        SELECT order_year, CAST(customer_rank AS INTEGER) AS customer_rank, c_custkey,
            customer_name, net_revenue
        FROM (
            SELECT year AS order_year, customer_key,
                CAST(sum(net_amount) AS DECIMAL(38,4)) AS net_revenue,
                rank() OVER (PARTITION BY year ORDER BY sum(net_amount) DESC) AS customer_rank
            FROM fact_sales LEFT JOIN dim_date ON order_date_key = date_key
            GROUP BY year, customer_key
        ) LEFT JOIN dim_customer USING (customer_key)
        WHERE customer_rank <= 10""",
    "customer_pareto": """
        SELECT region_name, c_custkey, order_total,
            CAST(sum(order_total) OVER running AS DECIMAL(38,2)) AS running_total,
            round(CAST(order_total AS DOUBLE)
                / CAST(sum(order_total) OVER whole AS DOUBLE), 8) AS share,
            round(CAST(sum(order_total) OVER running AS DOUBLE)
                / CAST(sum(order_total) OVER whole AS DOUBLE), 8) AS running_share
        FROM (
            SELECT dim_customer.region_name, c_custkey,
                CAST(sum(order_total) AS DECIMAL(38,2)) AS order_total
            FROM fact_orders JOIN dim_customer USING (customer_key)
            GROUP BY dim_customer.region_name, c_custkey
        )
        WINDOW whole AS (PARTITION BY region_name),
            running AS (PARTITION BY region_name ORDER BY order_total DESC, c_custkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "customer_recency": """
        SELECT c_custkey, max(o_orderdate) AS last_order_date,
            CAST(date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM s_orders))
                AS INTEGER) AS days_since_last_order,
            count(o_orderkey) AS order_count,
            CAST(coalesce(sum(o_totalprice), 0) AS DECIMAL(38,2)) AS order_total
        FROM s_customer LEFT JOIN s_orders ON o_custkey = c_custkey
        GROUP BY c_custkey""",
    "gross_to_net": """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag AS return_flag,
            CAST(sum(gross_amount) AS DECIMAL(38,2)) AS gross,
            CAST(sum(discount_amount) AS DECIMAL(38,4)) AS discount,
            CAST(sum(net_amount) AS DECIMAL(38,4)) AS net,
            CAST(sum(tax_amount) AS DECIMAL(38,6)) AS tax,
            CAST(sum(total_amount) AS DECIMAL(38,6)) AS total
        FROM amounts GROUP BY ALL""",
    "status_pivot": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END)
                AS DECIMAL(38,2)) AS status_f,
            CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END)
                AS DECIMAL(38,2)) AS status_o,
            CAST(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END)
                AS DECIMAL(38,2)) AS status_p,
            CAST(sum(CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN 0 ELSE o_totalprice END)
                AS DECIMAL(38,2)) AS status_other
        FROM s_orders GROUP BY ALL""",
}


def _build() -> dict[str, str]:
    plain = {"bronze_ingest": "SELECT *, 'lineitem' AS _source_table FROM lineitem"}
    plain |= {
        f"bronze_ingest_{table}": f"SELECT *, '{table}' AS _source_table FROM {table}"
        for table in _SILVER
        if table != "lineitem"
    }
    plain["bronze_manifest"] = " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS n_rows FROM {table}" for table in _SILVER
    )
    layered = {f"silver_{table}": f"SELECT * FROM s_{table}" for table in _SILVER}
    layered |= {
        "silver_geography": "SELECT * FROM geography",
        "silver_lineitem_amounts": "SELECT * FROM amounts",
        "silver_exact_dedup": "SELECT DISTINCT * FROM s_lineitem",
        "silver_dedup_latest": _LATEST_LINE,
        "silver_fk_valid": (
            "SELECT * FROM s_orders WHERE o_orderkey IS NULL OR EXISTS "
            "(SELECT 1 FROM s_lineitem WHERE l_orderkey = o_orderkey)"
        ),
        "silver_fk_quarantine": (
            "SELECT * FROM s_orders WHERE o_orderkey IS NOT NULL AND NOT EXISTS "
            "(SELECT 1 FROM s_lineitem WHERE l_orderkey = o_orderkey)"
        ),
    }
    layered |= {name: " UNION ALL ".join(checks) for name, checks in _CHECKS.items()}
    layered["dq_summary"] = " UNION ALL ".join(
        check for checks in _CHECKS.values() for check in checks
    )
    tables = (
        "dim_date",
        "dim_customer",
        "dim_product",
        "dim_supplier",
        "fact_sales",
        "fact_orders",
    )
    layered |= {table: f"SELECT * FROM {table}" for table in tables}
    layered |= _REPORTS
    return plain | {name: _with_layers(select) for name, select in layered.items()}


ORACLE_SQL = _build()
