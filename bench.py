"""Headline queries, timed once each after a warm-up; prints one JSON line.

BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_EVENTS   folder for Spark's event log (default: none)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellwarden.operators import relate as R
from cellwarden.operators.cells import data_columns, with_row_id
from cellwarden.operators.fusion import fuse_cells
from cellwarden.operators.profile import numeric_statistics
from cellwarden.operators.stats import fit
from cellwarden.plans.analyze import analyze
from cellwarden.plans.views import dirty_view
from cellwarden.sources.files import spread

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count())


def session() -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites are recorded per column expression otherwise.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if os.environ.get("BENCH_EVENTS"):
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", os.environ["BENCH_EVENTS"])
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def sink(df) -> None:
    """Compute every row and column."""
    df.write.format("noop").mode("overwrite").save()


def lineitem(spark, d):
    # The table has no unique key; ids of a plain file scan are the same in every pass.
    return spark.read.parquet(f"{d}/lineitem.parquet").withColumn("row_id", F.monotonically_increasing_id())


def pl1_orders(spark, d):
    a = analyze(dirty_view(spark, d, "dq_orders"), "row_id", "dq_orders")
    a.summary().collect()
    a.close()


def pl1_customer(spark, d):
    a = analyze(dirty_view(spark, d, "dq_customer"), "row_id", "dq_customer")
    a.summary().collect()
    a.close()


def pl1_lineitem(spark, d):
    a = analyze(lineitem(spark, d), "row_id", "lineitem")
    a.summary().collect()
    a.close()


def decisions_and_repair(spark, d):
    a = analyze(dirty_view(spark, d, "dq_orders"), "row_id", "dq_orders")
    sink(a.repaired())
    a.close()


def fd_mining(spark, d):
    df = spread(lineitem(spark, d))
    found = R.mine_fds(df, fit(df, data_columns(df, "row_id")))
    if found is not None:
        found.collect()
    df.unpersist()


def near_duplicates(spark, d):
    df = dirty_view(spark, d, "dq_customer")
    R.near_duplicates(df, fit(df, ["segment", "nation_name", "region_name"])).collect()


def fusion(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.lit("c").alias("column"),
        F.explode(F.array(
            F.struct(F.lit("a").alias("family"), F.lit("possible_error").alias("claim"), (F.col("l_discount") * 8).alias("score")),
            F.struct(F.lit("b").alias("family"), F.lit("uncertain").alias("claim"), (F.col("l_tax") * 8).alias("score")),
        )).alias("e")).select("row_id", "column", "e.*")
    sink(fuse_cells(e))


def numeric_profile(spark, d):
    numeric_statistics(lineitem(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).collect()


def outliers(spark, d):
    from cellwarden.operators.detect import row_evidence

    df = with_row_id(spark.read.parquet(f"{d}/events.parquet"), "event_id")
    sink(row_evidence(df, fit(df, ["value"]), ("outlier_detector",)))


BENCH = [pl1_orders, pl1_customer, pl1_lineitem, decisions_and_repair, fd_mining, near_duplicates,
         fusion, numeric_profile, outliers]


def main() -> None:
    spark = session()
    pl1_customer(spark, SF_DIR)  # start the JVM's compilers
    times = {}
    for fn in BENCH:
        start = time.time()
        fn(spark, SF_DIR)
        times[fn.__name__] = round(time.time() - start, 3)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows_per_sec_pl1_lineitem": round(rows / times["pl1_lineitem"]), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
