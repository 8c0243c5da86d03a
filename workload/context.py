"""Inputs of the registered queries: tables, dirty views and their analyses."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.plans.analyze import Analysis, analyze
from cellwarden.plans.views import dirty_view

_ANALYSES: dict[tuple, Analysis] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analysis(spark: SparkSession, sf_dir: str, view: str) -> Analysis:
    """The analysis of a dirty view by its defaults, fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _ANALYSES:
        _ANALYSES[key] = analyze(dirty_view(spark, sf_dir, view), "row_id", view)
    return _ANALYSES[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written results under the shared folder; only local sessions may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"run-{name}-")
    app = spark.sparkContext.applicationId
    unique = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{base.rstrip('/')}/{app}/{name}-{unique}"


def all_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of both views, told apart by ``dataset_id``."""
    return analysis(spark, sf_dir, "dq_orders").decisions.unionByName(
        analysis(spark, sf_dir, "dq_customer").decisions)
