"""CSV, TSV and Parquet sources, file fingerprints and row ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.sources import digests
from cellwarden.sources.quoted import quoted_rows

# --- Fixed values: readable formats by suffix ------------------------------
SEPARATORS = {".csv": ",", ".tsv": "\t"}
PARQUET_SUFFIXES = (".parquet", ".pq")

# --- Fixed values: wording of load warnings --------------------------------
W_EMPTY = "Dataset is empty (0 rows)"
W_FEW_COLUMNS = "Dataset has fewer than 2 columns — possible delimiter issue"
W_REPEATED_NAMES = "Duplicate column names detected"


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def unique_names(names: list[str]) -> list[str]:
    """Number repeated column names: a, a_1, a_2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, -1) + 1
        seen[n] = k
        out.append(n if k == 0 else f"{n}_{k}")
    return out


def column_types(lines: DataFrame, names: list[str]) -> list[str]:
    """``bigint``, ``double`` or ``string`` per text column.

    One aggregate over all rows decides: every value must read as a number.
    Dates stay text, for the format checks.
    """
    checks = []
    for c in names:
        filled = F.count(F.when(F.col(c).isNotNull(), 1))
        whole = F.count(F.col(c).try_cast("bigint") + F.when(~F.col(c).rlike(r"^[+-]?\d+$"), None).otherwise(0))
        real = F.count(F.when(F.col(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), 1))
        checks.append(F.when(filled == 0, "string").when(whole == filled, "bigint")
                      .when(real == filled, "double").otherwise("string"))
    return list(lines.agg(*[e.alias(f"t{i}") for i, e in enumerate(checks)]).first())


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8",
             keep_leading_zeros: bool = False, line_breaks: bool = True, splittable: bool = False) -> DataFrame:
    """A delimited file or folder with a header row.

    All columns are read as text first and typed by one aggregate, so the
    result does not depend on a sample. Lines with too many fields lose the
    rest, missing fields are null. ``keep_leading_zeros`` leaves a column
    with values such as 0901 as text.

    Quotes are doubled inside quoted fields, and fields may hold line breaks;
    a file is then read by one task. ``line_breaks=False`` lets Spark split
    large files that have none, ``splittable=True`` those that have some: in
    UTF-8, with quotes only around whole fields and doubled inside them, since
    a stray quote would move the borders of all records behind it. Rows then
    come in no fixed order. Repeated header names are numbered.
    """
    if splittable and encoding.upper() not in ("UTF-8", "UTF8"):
        raise ValueError("splittable files are read as UTF-8")
    options = dict(
        sep=SEPARATORS.get(suffix_of(path), ","), encoding=encoding, escape='"', multiLine=line_breaks,
        mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, inferSchema=False,
    )
    names = header_names(spark, path, options)
    if not names:
        return spark.read.csv(path, header=True, **options)
    if splittable:
        names[-1] = names[-1].removesuffix("\r")  # the line ends of the first line may not be told from its fields' breaks
        return typed(quoted_rows(spark, path, unique_names(names), options), keep_leading_zeros)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in unique_names(names)])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, **options)
    return typed(raw, keep_leading_zeros)


def header_names(spark: SparkSession, path: str, options: dict) -> list[str]:
    """The first line's fields as they stand; an unnamed one gets its place."""
    first = spark.read.csv(path, header=False, **options).first()
    return [] if first is None else [f"_c{i}" if c is None else c for i, c in enumerate(first)]


def typed(raw: DataFrame, keep_leading_zeros: bool = False) -> DataFrame:
    """A table of text columns with its numbers as numbers."""
    lines = raw.toDF(*unique_names(raw.columns))
    if not lines.columns:
        return lines
    kinds = column_types(lines, lines.columns)
    if keep_leading_zeros:
        padded = lines.agg(*[F.count_if(F.col(c).rlike(r"^[+-]?0\d")).alias(c) for c in lines.columns]).first()
        kinds = ["string" if n else k for k, n in zip(kinds, padded)]
    return lines.select(*[
        F.col(c) if k == "string" else F.col(c).try_cast(k).alias(c) for c, k in zip(lines.columns, kinds)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by suffix."""
    suffix = suffix_of(path)
    if suffix in SEPARATORS:
        return read_csv(spark, path, **options)
    if suffix in PARQUET_SUFFIXES:
        return read_parquet(spark, path)
    known = ", ".join(sorted((*SEPARATORS, *PARQUET_SUFFIXES)))
    raise ValueError(f"Unsupported file format: {suffix}. Supported: {known}")


def warnings(df: DataFrame, header: list[str] | None = None) -> list[str]:
    """What looks wrong with a freshly read table."""
    out = []
    if df.isEmpty():
        out.append(W_EMPTY)
    if len(df.columns) < 2:
        out.append(W_FEW_COLUMNS)
    if header is not None and len(set(header)) < len(header):
        out.append(W_REPEATED_NAMES)
    return out


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file under a path, hashed in tasks.

    Files beyond ``digests.PIECE`` bytes are read in splits and hashed piece
    by piece; this runs at once, and the pieces lie in the shared folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = ("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes"))
    whole = files.filter(~digests.is_large()).select(*columns, F.sha2("content", 256).alias("sha256"))
    large = files.filter(digests.is_large()).select(F.col("_metadata.file_path").alias("file"), *columns)
    if large.isEmpty():
        return whole
    return whole.union(large.join(digests.large_files(spark, path, _stored), "file").drop("file"))


def _stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``df`` written as Parquet to a new folder that all executors share, and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-digests-")
    folder = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4()}"
    # Rows of pieces are long: writers and readers hold a row group.
    df.write.option("parquet.block.size", 32 << 20).partitionBy(*partitions).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def load_metadata(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """One row about a loaded table: format, files, size, digest and counts."""
    counts = df.agg(F.count(F.lit(1)).alias("row_count"))
    joined = lambda c: F.sha2(F.concat_ws("", F.array_sort(F.collect_list(c))), 256)
    # Digests of digests in two levels: 4096 groups, so that no task joins all files' digests.
    groups = fingerprints(spark, path).groupBy(F.substring("sha256", 1, 3).alias("start")).agg(
        F.count("*").alias("n"), F.sum("file_size_bytes").alias("size"), joined("sha256").alias("root"))
    files = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sum("size").alias("file_size_bytes"), joined("root").alias("sha256"))
    return files.withColumns({
        "file_format": F.lit(suffix_of(path).lstrip(".")),
        "column_count": F.lit(len(df.columns)),
        "row_count": counts.select("row_count").scalar(),
    })


def number_rows(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Add a dense 0-based ``row_id`` in file order, for tables without a key.

    Each partition counts itself; the offsets are one small row per
    partition. Do this once at ingest and keep the result as Parquet.

    Rows are counted in one pass and numbered in another, and both must split
    them alike. Files read as they are do; anything else, such as shuffled
    rows, needs a shared ``folder`` to which the marked rows are written first.
    """
    marked = df.withColumn("_mono", F.monotonically_increasing_id())
    if folder is not None:
        marked.write.parquet(folder)
        marked = df.sparkSession.read.schema(marked.schema).parquet(folder)
    part, place = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return (
        marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn("row_id", F.col("_before") + place).drop("_part", "_before", "_mono")
    )


# Estimated bytes up to which an input is kept in memory.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Cache a small table in one piece per core.

    A small file is often a single piece, and one task would do the work of
    every pass over it. The optimizer's size estimate decides, without
    running anything; it errs upwards for joins. Anything larger, or of
    unknown size, is returned as it is.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate > SMALL_INPUT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
