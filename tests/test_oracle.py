"""Registered queries against their SQL in DuckDB, at the smallest scale.

``ORACLE=all`` runs every query; by default one per group of operators.
"""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SOME = ("io1_quoted_csv", "io5_load_warnings", "sc7_indel_similarity", "det9_fd_mining", "det9_fd_mining_lineitem",
        "pr6b_shapes_of_pages", "pr6c_shapes_of_documents", "pr6_pattern_distribution", "pr9_examples", "au1_repair_events", "au1_review_events", "au3_timeline",
        "io2_parquet_scan", "sc1_shape", "sc9_iso_date", "pr4_numeric_stats", "pr8_cardinality",
        "det4_pattern_rarity", "det7_near_duplicate", "det9_fd_violation", "fu5_table_rows_cautious",
        "de2_gate", "de3_decisions_customer", "de3_decisions_orders", "re1_auto_repair", "re4_edit_commands",
        "rv1_review_queue", "au5_hash_batches")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal, float)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
