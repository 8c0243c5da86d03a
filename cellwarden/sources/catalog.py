"""Datasets, their decisions and ledger as Parquet tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.operators.ledger import append_events, event_id


class Catalog:
    """Dataset versions below ``root``, made visible by one manifest row each.

    A version is written to a folder of its own, which nothing overwrites; the
    last step appends a row to the manifest that points to it. So a write that
    stops half-way leaves the former version as it is, and readers, who first
    take the manifest's newest row of a dataset, see whole versions only. A
    deleted dataset gets a row that says so. Manifest rows are tiny, one per
    version; nothing else passes the driver.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def manifest(self) -> DataFrame:
        """One row per published version or deletion."""
        return self.spark.read.option("mergeSchema", "true").parquet(self._path("manifest"))

    def _versions(self, dataset_id: str) -> list:
        """(version, folder, deleted) of a dataset, oldest first; none before the first dataset."""
        try:
            rows = self.manifest()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return (rows.where(F.col("dataset_id") == dataset_id).select("version", "folder", "deleted")
                .orderBy("version").collect())

    def _publish(self, row: DataFrame, dataset_id: str, version: int, folder: str | None, ts: str) -> None:
        """The commit: one file with one row."""
        row.limit(1).drop("dataset_id").select(
            F.lit(dataset_id).alias("dataset_id"), "*", F.lit(ts).cast("timestamp").alias("registered_at"),
            F.lit(version).cast("long").alias("version"), F.lit(folder).cast("string").alias("folder"),
            F.lit(folder is None).alias("deleted")).coalesce(1).write.mode("append").parquet(self._path("manifest"))

    def ledger(self) -> DataFrame:
        return self.spark.read.parquet(self._path("ledger"))

    def _event(self, event_type: str, dataset_id: str, ts: str) -> None:
        event = self.spark.range(1).select(
            event_id(F.lit(event_type), F.lit(dataset_id), F.lit(ts)).alias("id"),
            F.lit(event_type).alias("event_type"), F.lit("system").alias("actor"),
            F.lit(dataset_id).alias("dataset_id"), F.lit(None).cast("string").alias("decision_id"),
            F.lit(None).cast("map<string,string>").alias("details"),
            F.lit(ts).cast("timestamp").alias("ts"))
        append_events(event, self._path("ledger"))

    def register(self, dataset_id: str, summary: DataFrame | Callable[[DataFrame], DataFrame], decisions: DataFrame,
                 ts: str, table: DataFrame | None = None) -> int:
        """A new version with its decisions and, if given, the table itself; its number.

        The ledger is written first, so that a failed write there stops the rest.
        ``summary`` may be a function of the decisions: it is given the written
        ones, so that costly decisions run once.
        """
        self._event("UPLOAD", dataset_id, ts)
        version = max((r["version"] for r in self._versions(dataset_id)), default=0) + 1
        folder = f"{self._path('versions')}/{dataset_id}/v{version}-{uuid.uuid4()}"
        decisions.drop("dataset_id").write.parquet(f"{folder}/decisions")
        if table is not None:
            table.write.parquet(f"{folder}/table")
        if not isinstance(summary, DataFrame):
            stored = self.spark.read.schema(decisions.drop("dataset_id").schema).parquet(f"{folder}/decisions")
            summary = summary(stored.withColumn("dataset_id", F.lit(dataset_id)))
        self._publish(summary, dataset_id, version, folder, ts)
        return version

    def _newest(self) -> DataFrame:
        rows = self.manifest()
        newest = rows.groupBy("dataset_id").agg(F.max("version").alias("version"))
        return rows.join(newest, ["dataset_id", "version"]).where("not deleted").drop("deleted")

    def datasets(self) -> DataFrame:
        """Summary, version and folder of every dataset that is not deleted."""
        return self._newest()

    def dataset(self, dataset_id: str) -> DataFrame:
        return self.datasets().where(F.col("dataset_id") == dataset_id)

    def _folder(self, dataset_id: str, version: int | None) -> str | None:
        """Where a version lies: the newest, unless one is named; None if deleted or never registered."""
        rows = [r for r in self._versions(dataset_id) if version is None or r["version"] == version]
        return rows[-1]["folder"] if rows else None

    def decisions(self, dataset_id: str, version: int | None = None) -> DataFrame:
        """A snapshot: later versions do not change it. Without a dataset of this name, no rows."""
        folder = self._folder(dataset_id, version)
        if folder is None:
            return self.spark.createDataFrame([], "dataset_id string")
        return self.spark.read.parquet(f"{folder}/decisions").withColumn("dataset_id", F.lit(dataset_id))

    def reload(self, dataset_id: str, version: int | None = None) -> DataFrame:
        """The table as it was registered."""
        folder = self._folder(dataset_id, version)
        if folder is None:
            raise ValueError(f"no dataset {dataset_id}")
        return self.spark.read.parquet(f"{folder}/table")

    def delete(self, dataset_id: str, ts: str) -> None:
        """Former versions stay readable by their number."""
        self._event("DELETE", dataset_id, ts)
        version = max((r["version"] for r in self._versions(dataset_id)), default=0) + 1
        self._publish(self.spark.range(1).select(), dataset_id, version, None, ts)


def write_cleaned(df: DataFrame, root: str, dataset_id: str, version: int, fmt: str = "parquet") -> str:
    """Write a repaired table to a new versioned folder; the source stays."""
    path = f"{root.rstrip('/')}/{dataset_id}_cleaned/v={version}"
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return path
