"""Drift of columns against a stored profile, the input of gate rule 7.

A profile counts the rows of each column by bin: tenths of the baseline for
numbers and times, the most frequent values for text and length classes for
the rest of it. A later batch is counted by the same bins, and the population
stability index of the two says how far the column has moved. Both are one
scan with map-side counts; a profile has a bounded number of rows per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellwarden.operators.stats import exact_quantiles

TENTHS = tuple(i / 10 for i in range(1, 10))
TOP_VALUES = 20
LONGEST_VALUE = 64  # longer texts count by length only
MAX_DRIFT = 0.25  # the customary border of a large shift
HALF = 0.5  # added to each count, so that an empty bin has a logarithm

PROFILE_SCHEMA = "column string, bin string, n bigint, edges array<double>, top array<string>"


def _numbers(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Columns with an order, as doubles."""
    out = {}
    for c in names:
        kind = df.schema[c].dataType
        if isinstance(kind, T.NumericType):
            out[c] = F.col(f"`{c}`").cast("double")
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            out[c] = F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double")
    return out


def _frame(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The named columns as doubles or text, under their place, and the places of the doubles."""
    numbers = _numbers(df, names)
    each = [numbers.get(c, F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(names)]
    return df.select(*each), [f"c{i}" for i, c in enumerate(names) if c in numbers]


def _edges(frame: DataFrame, places: list[str]) -> dict[str, list[float]]:
    if not places:
        return {}
    finite = frame.select(*[F.when(~F.isnan(p), F.col(p)).alias(p) for p in places])
    out: dict[str, list[float]] = {}
    for r in exact_quantiles(finite, places, TENTHS).orderBy("column", "p").collect():
        out.setdefault(r["column"], []).append(r["value"])
    return out


def _top(frame: DataFrame, places: list[str]) -> dict[str, list[str]]:
    """The most frequent short values of each text column, ties by value."""
    if not places:
        return {}
    cells = frame.select(F.inline(F.array(*[F.struct(F.lit(p).alias("place"), F.col(p).alias("value")) for p in places])))
    counts = cells.where(F.length("value") <= LONGEST_VALUE).groupBy("place", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "value"))
    out: dict[str, list[str]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= TOP_VALUES).select("place", "value").collect():
        out.setdefault(r["place"], []).append(r["value"])
    return out


def _bin(place: str, is_number: bool, edges: list[float], top: list[str]) -> Column:
    v = F.col(place)
    if is_number:
        below = sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
        return F.when(v.isNull(), "missing").when(F.isnan(v), "nan").otherwise(
            F.concat(F.lit("tenth "), below.cast("string")))
    size = F.concat(F.lit("length "), F.length(F.bin(F.length(v).cast("long"))).cast("string"))
    named = F.when(v.isin(*top), F.concat(F.lit("value "), v)) if top else F.when(F.lit(False), "")
    return F.when(v.isNull(), "missing").otherwise(F.coalesce(named, size))


def _counts(frame: DataFrame, names: list[str], numbers: list[str], edges: dict, top: dict) -> DataFrame:
    """(column, bin, n): one scan, counted before anything is shuffled."""
    cells = [F.struct(F.lit(c).alias("column"), _bin(f"c{i}", f"c{i}" in numbers, edges.get(c, []), top.get(c, [])).alias("bin"))
             for i, c in enumerate(names)]
    return frame.select(F.inline(F.array(*cells))).groupBy("column", "bin").agg(F.count("*").alias("n"))


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, bin, n, edges, top): the bins of each column and their rows; keep it beside a dataset version.

    Nulls have their own bin, so have NaNs; an empty table has no rows here.
    """
    frame, numbers = _frame(df, names)
    edges = _edges(frame, numbers)
    top = _top(frame, [f"c{i}" for i in range(len(names)) if f"c{i}" not in numbers])
    by_name = lambda of: {c: of[f"c{i}"] for i, c in enumerate(names) if f"c{i}" in of}
    edges, top = by_name(edges), by_name(top)
    bins = df.sparkSession.createDataFrame(
        [(c, edges.get(c, []), top.get(c, [])) for c in names], "column string, edges array<double>, top array<string>")
    counted = _counts(frame, names, numbers, edges, top)
    return counted.join(F.broadcast(bins), "column").select("column", "bin", "n", "edges", "top")


def drift(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """(column, n_bins, baseline_rows, batch_rows, psi) of ``df`` against a stored ``profile``.

    The driver reads the bins, a bounded number per column. A column that the
    batch lacks is refused. A batch or baseline without rows has no psi.
    """
    bins = {r["column"]: r for r in baseline.select("column", "edges", "top").distinct().collect()}
    names = sorted(bins)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns of the profile that the batch lacks: {missing}")
    frame, numbers = _frame(df, names)
    now = (_counts(frame, names, numbers, {c: r["edges"] for c, r in bins.items()}, {c: r["top"] for c, r in bins.items()})
           if names else df.sparkSession.createDataFrame([], "column string, bin string, n bigint"))
    both = baseline.select("column", "bin", F.col("n").alias("was"), F.lit(0).cast("long").alias("now")).unionByName(
        now.select("column", "bin", F.lit(0).cast("long").alias("was"), F.col("n").alias("now")))
    both = both.groupBy("column", "bin").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    of = Window.partitionBy("column")
    both = both.withColumns({"n_bins": F.count("*").over(of), "all_was": F.sum("was").over(of), "all_now": F.sum("now").over(of)})
    share = lambda n, total: (F.col(n) + HALF) / (F.col(total) + HALF * F.col("n_bins"))
    p, q = share("was", "all_was"), share("now", "all_now")
    psi = F.round(F.sum((q - p) * F.log(q / p)), 6)
    return (both.groupBy("column", "n_bins", F.col("all_was").alias("baseline_rows"), F.col("all_now").alias("batch_rows"))
            .agg(psi.alias("psi")).withColumn("psi", F.when((F.col("baseline_rows") > 0) & (F.col("batch_rows") > 0), F.col("psi"))))


def drifted_columns(df: DataFrame, baseline: DataFrame, max_drift: float = MAX_DRIFT) -> list[str]:
    """Names of the columns whose psi lies above ``max_drift``."""
    return sorted(r["column"] for r in drift(df, baseline).where(F.col("psi") > max_drift).select("column").collect())


def with_drift(context: DataFrame, columns: list[str]) -> DataFrame:
    """Gate contexts with ``out_of_distribution`` for the cells of drifted columns."""
    return context.withColumn("out_of_distribution", F.col("column").isin(*columns) if columns else F.lit(False))
