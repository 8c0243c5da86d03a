"""Detection, duplicate keys and quality metrics on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellwarden.operators.decide import decide, gate_context
from cellwarden.operators.detect import ROW_DETECTORS, outlier_bounds, row_evidence
from cellwarden.operators.evidence import describe
from cellwarden.operators.stats import TableStats
from cellwarden.streaming.late import run_window_log, windows_as_of

STREAM_DETECTORS = tuple(d for d in ROW_DETECTORS if d != "date_format_detector")


def stream_evidence(stream: DataFrame, baseline: TableStats, dataset_id: str) -> DataFrame | None:
    """Evidence rows of a stream against a fitted baseline, without state."""
    found = row_evidence(stream, baseline, STREAM_DETECTORS)
    return None if found is None else describe(found, dataset_id)


def run_detection(stream: DataFrame, baseline: TableStats, dataset_id: str,
                  out: str, checkpoint: str) -> StreamingQuery:
    """Decide each micro-batch and write it; a repeated batch replaces itself.

    A cell's evidence always lies in one batch, so deciding per batch equals
    deciding over the whole input.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        evidence = stream_evidence(batch, baseline, dataset_id)
        if evidence is not None:
            decide(gate_context(evidence)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_key_counts(stream: DataFrame, key: str, time: str, late: str, window: str) -> DataFrame:
    """Keys seen more than once per event-time window; closed windows leave the state."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window), F.col(key)).agg(F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("window.start").alias("window_start"), key, "copies")
    )


def stream_distinct(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First arrival per key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _outside(baseline: TableStats, column: str):
    fences = outlier_bounds(baseline.columns[column])
    return F.lit(False) if fences is None else ((F.col(column) < fences[0]) | (F.col(column) > fences[1]))


def run_quality_log(stream: DataFrame, baseline: TableStats, column: str, time: str, window: str, late: str,
                    out: str, checkpoint: str) -> StreamingQuery:
    """Quality of one numeric column per tumbling window as an update log, so that late rows correct closed windows."""
    sums = {"n_rows": F.lit(1).cast("long"), "n_null": F.col(column).isNull().cast("long"),
            "n_outside": F.when(_outside(baseline, column), 1).otherwise(0).cast("long")}
    return run_window_log(stream, time, window, late, sums, out, checkpoint)


def quality_as_of(spark, out: str, version: int | None = None) -> DataFrame:
    """Null and outlier rates per window after a batch (default: the last), with version and corrections."""
    rows = windows_as_of(spark, out, ["n_rows", "n_null", "n_outside"], version=version)
    return rows.select("window_start", "n_rows", F.round(F.col("n_null") / F.col("n_rows"), 4).alias("null_rate"),
                       F.round(F.col("n_outside") / F.col("n_rows"), 4).alias("outlier_rate"), "version", "corrections")


def quality_metrics(stream: DataFrame, baseline: TableStats, column: str, time: str,
                    window: str, late: str | None = None) -> DataFrame:
    """Null and outlier rates of one numeric column per tumbling window."""
    outside = _outside(baseline, column)
    source = stream if late is None else stream.withWatermark(time, late)
    return source.groupBy(F.window(time, window)).agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg(F.col(column).isNull().cast("double")), 4).alias("null_rate"),
        F.round(F.avg(F.when(outside, 1.0).otherwise(0.0)), 4).alias("outlier_rate"),
    ).select(F.col("window.start").alias("window_start"), "n_rows", "null_rate", "outlier_rate")
