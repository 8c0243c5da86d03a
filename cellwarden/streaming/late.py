"""Streams whose rows may come late: nothing behind the watermark is lost or left uncounted.

Each micro-batch writes its own folders, ``batch=<id>``, and reads only those
of earlier batches, so a repeated batch replaces itself and a restart goes on
where it stopped. The watermark of a batch is the greatest event time of all
earlier ones less the allowed lateness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

CLOCK = "latest timestamp, batch long"


def _earlier(spark: SparkSession, folder: str, schema: str | StructType, batch_id: int) -> DataFrame | None:
    """What earlier batches wrote to a folder; None before the first."""
    if batch_id == 0:
        return None
    return spark.read.schema(schema).parquet(folder).where(F.col("batch") < batch_id)


def watermark(spark: SparkSession, out: str, batch_id: int, late: str) -> Column | None:
    """Rows of this batch before it are late; None while nothing came earlier."""
    clock = _earlier(spark, f"{out}/clock", CLOCK, batch_id)
    latest = None if clock is None else clock.agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("at")).first()["at"]
    return None if latest is None else F.lit(latest)


def _tick(batch: DataFrame, out: str, time: str, batch_id: int) -> None:
    batch.agg(F.max(time).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{out}/clock/batch={batch_id}")


def _start(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_distinct(stream: DataFrame, keys: list[str], time: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """First arrivals per key to ``out/rows``; rows behind the watermark to ``out/late``, whole.

    Keys are remembered while a row of the same time could still arrive on
    time. Rows without a time are late from the start.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        at = watermark(spark, out, batch_id, late)
        in_time = F.col(time).isNotNull() if at is None else F.coalesce(F.col(time) >= at, F.lit(False))
        _tick(batch, out, time, batch_id)
        batch.where(~in_time).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        order = Window.partitionBy(*keys).orderBy(time, F.xxhash64(*batch.columns))
        first = batch.where(in_time).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
        known = StructType([batch.schema[c] for c in dict.fromkeys([*keys, time])]).add("batch", "long")
        seen = _earlier(spark, f"{out}/seen", known, batch_id)
        if seen is not None:
            if at is not None:
                seen = seen.where(F.col(time) >= at)
            seen = seen.select(*[F.col(k).alias(f"_seen_{i}") for i, k in enumerate(keys)]).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_seen_{i}")) for i, k in enumerate(keys)]
            first = first.join(seen, same, "left_anti")
        first.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        spark.read.schema(batch.schema).parquet(f"{out}/rows/batch={batch_id}").select(
            *known.fieldNames()[:-1]).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")
        batch.unpersist()

    return _start(stream, write, checkpoint)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came behind the watermark, with their batch."""
    return spark.read.parquet(f"{out}/late")


def run_window_log(stream: DataFrame, time: str, window: str, late: str, sums: dict[str, Column], out: str,
                   checkpoint: str, keys: tuple[str, ...] = ()) -> StreamingQuery:
    """An update log of tumbling windows: per batch, what it adds to each window it touches.

    ``sums`` are numbers per row that add up. A row of the log has its window,
    ``keys``, these sums, and ``closed``: the watermark had passed the
    window's end, so that a published figure is corrected. Rows without a
    time have a null window.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        at = watermark(batch.sparkSession, out, batch_id, late)
        _tick(batch, out, time, batch_id)
        span = F.window(time, window)
        rows = batch.where(F.col(time).isNotNull()).select(
            span["start"].alias("window_start"), span["end"].alias("window_end"), *keys,
            *[e.alias(name) for name, e in sums.items()])
        rows = rows.unionByName(batch.where(F.col(time).isNull()).select(
            F.lit(None).cast("timestamp").alias("window_start"), F.lit(None).cast("timestamp").alias("window_end"), *keys,
            *[e.alias(name) for name, e in sums.items()]))
        added = rows.groupBy("window_start", "window_end", *keys).agg(*[F.sum(name).alias(name) for name in sums])
        closed = F.lit(False) if at is None else F.coalesce(F.col("window_end") <= at, F.lit(False))
        added.withColumn("closed", closed).drop("window_end").write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")
        batch.unpersist()

    return _start(stream, write, checkpoint)


def windows_as_of(spark: SparkSession, out: str, sums: list[str], keys: tuple[str, ...] = (),
                  version: int | None = None) -> DataFrame:
    """The log merged: each window's sums after batch ``version`` (default: all), its last version and corrections."""
    log = spark.read.parquet(f"{out}/log")
    if version is not None:
        log = log.where(F.col("batch") <= version)
    return log.groupBy("window_start", *keys).agg(
        *[F.sum(s).alias(s) for s in sums], F.max("batch").cast("long").alias("version"),
        F.count_if("closed").alias("corrections"))


def changes(spark: SparkSession, out: str, sums: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Retractions and updates: for every version of a window the sums it replaces and those it states."""
    order = Window.partitionBy("window_start", *keys).orderBy("batch")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = spark.read.parquet(f"{out}/log")
    return log.select("window_start", *keys, F.col("batch").cast("long").alias("version"), "closed",
                      *[F.sum(s).over(upto).alias(s) for s in sums],
                      *[(F.sum(s).over(upto) - F.col(s)).alias(f"replaced_{s}") for s in sums])
