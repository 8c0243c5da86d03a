"""Costly inputs are read once where one pass is enough."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwarden.operators import decide as D
from cellwarden.operators import ledger as L
from cellwarden.operators import relate as R
from cellwarden.operators.stats import fit
from cellwarden.sources.catalog import Catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_violations_of_small_groups_are_joined_without_salts(spark):
    """A table of many rows whose x values are rare has no hot group."""
    rows = [(i, f"k{i // 8}", None if i % 40 == 5 else f"odd{i}" if i % 20 == 3 else f" v{i // 8}", "n/a" if i % 8 == 6 else "z" * 90 + str(i // 16))
            for i in range(800)]
    df = spark.createDataFrame(rows, "row_id bigint, x string, y string, z string")
    stats = fit(df, ["x", "y", "z"])
    fds = [("x", "y", 0.95), ("x", "z", 1.0)]
    found = R.fd_violations(df, stats, fds, rows_per_task=100)  # 800 rows, 8 to a value
    assert "_salt" not in _plan(found)
    show = lambda f: sorted(map(str, f.collect()))
    assert show(found) == show(R.fd_violations(df, stats, fds, rows_per_task=7))
    assert sorted((r["row_id"], r["expected_value"]) for r in found.collect()) == [
        (i, f"v{i // 8}") for i in range(800) if i % 20 == 3]


def _decisions(spark, path):
    rows = [("a" if i < 50 else None if i < 53 else "b", f"d{i}", i // 2, f"c{i % 2}", "AUTO" if i % 3 else "BLOCK", 1)
            for i in range(90)]
    df = spark.createDataFrame(rows, "dataset_id string, decision_id string, row_id bigint, column string, decision string, evidence_count int")
    df.withColumns({"belief_error": F.lit(0.5), "conflict_k": F.lit(0.0)}).write.parquet(path)
    return spark.read.parquet(path)


def test_capped_events_read_the_decisions_once(spark, tmp_path):
    decisions = _decisions(spark, str(tmp_path / "d"))
    out = L.capped_decision_events(decisions, F.lit("2024-01-01").cast("timestamp"), cap=10)
    assert _plan(out).count("FileScan parquet") == 1
    events = out.collect()
    single = [e for e in events if e["event_type"] != "BATCH_DECISIONS"]
    assert sorted(e["decision_id"] for e in single) == sorted(f"d{i}" for i in [*range(10), *range(50, 63)])
    totals = {e["dataset_id"]: e["details"] for e in events if e["event_type"] == "BATCH_DECISIONS"}
    assert set(totals) == {"a", "b"}
    assert totals["a"] == {"total_decisions": "50", "auto_count": "33", "escalate_count": "0", "block_count": "17"}
    few = L.capped_decision_events(decisions, F.lit("2024-01-01").cast("timestamp"), cap=60).collect()
    assert len(few) == 90 and all(e["decision_id"] for e in few)


def test_catalog_takes_the_summary_from_the_stored_decisions(spark, tmp_path):
    decisions = _decisions(spark, str(tmp_path / "d")).where("dataset_id = 'a'")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.register("a", D.summarize, decisions, "2024-01-01 00:00:00")
    r = catalog.datasets().first()
    assert (r["dataset_id"], r["total_decisions"], r["auto_count"], r["block_count"]) == ("a", 50, 33, 17)
