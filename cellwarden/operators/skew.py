"""Joining rows back to per-group statistics when some groups are huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    spread: str,
    largest: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner join of ``rows`` to one ``groups`` record per key.

    ``size`` is the group's row count in ``groups``. A group above
    ``rows_per_task`` is split over ``ceil(size / rows_per_task)`` salts taken
    from a hash of the ``spread`` column, so no task receives a whole hot
    group. The list of hot keys has at most (rows / rows_per_task) entries of
    two numbers each, which bounds what is broadcast.

    ``largest`` is an upper bound of the group size, when one is known; at or
    below ``rows_per_task`` the join needs no salt.
    """
    if largest is not None and largest <= rows_per_task:
        return rows.join(groups, keys)
    key_hash = F.xxhash64(*keys)
    hot = (
        groups.where(F.col(size) > rows_per_task)
        .groupBy(key_hash.alias("_kh"))
        .agg(F.max(F.ceil(F.col(size) / rows_per_task)).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted_rows = (
        rows.withColumn("_kh", key_hash)
        .join(F.broadcast(hot), "_kh", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
        .drop("_kh", "_parts")
    )
    salted_groups = (
        groups.withColumn("_kh", key_hash)
        .join(F.broadcast(hot), "_kh", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_kh", "_parts")
    )
    return salted_rows.join(salted_groups, keys + ["_salt"]).drop("_salt")
