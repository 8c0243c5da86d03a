"""Views over the test tables with errors injected by key arithmetic.

Every row of the base table is kept. The SQL is portable; only the two date
formatters differ between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_DATES = {
    "iso": "date_format(o_orderdate, 'yyyy-MM-dd')",
    "dmy": "date_format(o_orderdate, 'dd/MM/yyyy')",
}
DUCKDB_DATES = {
    "iso": "strftime(o_orderdate, '%Y-%m-%d')",
    "dmy": "strftime(o_orderdate, '%d/%m/%Y')",
}

DQ_ORDERS = """
SELECT o_orderkey AS row_id,
       o_custkey AS customer,
       o_orderstatus AS order_state,
       CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS total_price,
       CASE WHEN o_orderkey % 53 = 0 THEN {dmy} ELSE {iso} END AS ordered_date,
       CASE WHEN o_orderkey % 101 = 0 THEN concat('  ', o_orderpriority, ' ')
            WHEN o_orderkey % 103 = 0 THEN 'N/A'
            WHEN o_orderkey % 107 = 0 THEN NULL
            ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 211 = 0 THEN concat('abc', CAST(o_orderkey % 7 AS VARCHAR(20)))
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) END AS units
FROM orders
"""

DQ_CUSTOMER = """
SELECT c.c_custkey AS row_id,
       CASE WHEN c.c_custkey % 50 = 49 THEN c.c_custkey - 1 ELSE c.c_custkey END AS customer_code,
       c.c_name AS full_name,
       c.c_nationkey AS nation_no,
       CASE WHEN c.c_custkey % 89 = 0 THEN 'NATION_X' ELSE n.n_name END AS nation_name,
       r.r_name AS region_name,
       CASE WHEN c.c_custkey = 7 THEN 'BUILDNG' WHEN c.c_custkey = 11 THEN 'AUTOMOBLE'
            WHEN c.c_custkey = 13 THEN 'MACHINRY' WHEN c.c_custkey = 17 THEN 'FURNTURE'
            WHEN c.c_custkey = 19 THEN 'HOUSEHLD' ELSE c.c_mktsegment END AS segment,
       concat('user', CAST(c.c_custkey AS VARCHAR(20)),
              CASE WHEN c.c_custkey % 70 = 0 THEN ' at ' ELSE '@' END, 'example.com') AS contact,
       c.c_acctbal AS balance
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

VIEWS = {"dq_orders": DQ_ORDERS, "dq_customer": DQ_CUSTOMER}


def duckdb_sql(name: str) -> str:
    return VIEWS[name].format(**DUCKDB_DATES)


def dirty_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables of ``sf_dir``."""
    sql = VIEWS[name].format(**SPARK_DATES)
    tables = {"dq_orders": ["orders"], "dq_customer": ["customer", "nation", "region"]}[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **frames)
