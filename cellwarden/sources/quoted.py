"""Quoted CSV files read by many tasks, line breaks inside fields included.

Files are split as plain lines. Whether a split starts inside a quoted field
follows from the quotes before it: each split's quotes are counted, and the
counts summed along the file, one small row per split. With that flag every
task puts its own lines together to records; only the records that cross a
border of splits are shuffled, as pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a row of ``pieces`` is.
WHOLE, BEGINS, GOES_ON = 0, 1, 2
_SHAPE = "value string, file string, start long, piece int, header boolean"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): lines in file order within each split; only LF parts them."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def inside_splits(lines: DataFrame) -> DataFrame:
    """(split): hash of the splits that start inside a quoted field, 8 bytes for each."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    of_split = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return of_split.withColumn("before", before).filter("before % 2 = 1").select(F.xxhash64("file", "start").alias("split"))


class _Split:
    """One split's lines on their way to records."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start, self.open = file, start, inside
        self.header = start == 0  # the file's first record is still to come
        self.kind, self.names_columns, self.lines = GOES_ON if inside else WHOLE, False, []

    def take(self, value: pa.Array) -> Iterator[pa.RecordBatch]:
        after = (np.cumsum(pc.count_substring(value, '"').to_numpy(zero_copy_only=False)) + self.open) % 2
        before = np.concatenate(([int(self.open)], after[:-1]))
        whole = (before == 0) & (after == 0) & (pc.binary_length(value).to_numpy(zero_copy_only=False) > 0)
        first = -1
        if self.header:
            filled = np.flatnonzero(whole | (after == 1))
            if len(filled):
                first, self.header = filled[0], False
        parts = np.flatnonzero((before == 1) | (after == 1))
        for i, text in zip(parts.tolist(), value.take(pa.array(parts)).to_pylist(), strict=True):
            if before[i] == 0:
                self.kind, self.names_columns = BEGINS, i == first
            self.lines.append(text)
            if after[i] == 0:
                yield from self.emit(WHOLE if self.kind == BEGINS else GOES_ON)
        self.open = bool(after[-1])
        if first >= 0:
            whole[first] = False
        alone = value.filter(pa.array(whole))
        n = len(alone)
        yield _rows(alone, [None] * n, [None] * n, [WHOLE] * n, [False] * n)

    def emit(self, kind: int) -> Iterator[pa.RecordBatch]:
        text, self.lines = "\n".join(self.lines), []
        if kind != WHOLE:
            yield _rows([text], [self.file], [self.start], [kind], [self.names_columns])
        elif not self.names_columns:
            yield _rows([text], [None], [None], [WHOLE], [False])
        self.kind, self.names_columns = WHOLE, False

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.lines:
            yield from self.emit(self.kind)


def _rows(value, file, start, piece, header) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [value if isinstance(value, pa.Array) else pa.array(value, pa.string()), pa.array(file, pa.string()),
         pa.array(start, pa.int64()), pa.array(piece, pa.int32()), pa.array(header, pa.bool_())],
        names=["value", "file", "start", "piece", "header"])


def pieces(lines: DataFrame) -> DataFrame:
    """Whole records without the headers, and the pieces of those that cross splits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            # A task can hold several splits, one after the other.
            new = np.flatnonzero((starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                file, start = files[lo].as_py(), int(starts[lo])
                if now is None or (now.file, now.start) != (file, start):
                    if now is not None:
                        yield from now.close()
                    now = _Split(file, start, batch.column("inside")[lo].as_py())
                yield from now.take(batch.column("value").slice(lo, hi - lo))
        if now is not None:
            yield from now.close()

    # One hash per split: the table is no larger than the list of splits that the scan itself is planned from.
    flags = F.broadcast(inside_splits(lines).withColumn("inside", F.lit(True)))
    marked = lines.withColumn("split", F.xxhash64("file", "start")).join(flags, "split", "left")
    return marked.select("value", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(run, _SHAPE)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every record of the files under ``path``, headers and empty lines left out."""
    found = pieces(split_lines(spark, path))
    order = Window.partitionBy("file").orderBy("start", F.desc("piece"))
    crossing = found.filter(F.col("piece") != WHOLE).withColumn("record", F.sum((F.col("piece") == BEGINS).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "value")))
    joined = crossing.groupBy("file", "record").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), F.max("header").alias("header"))
    rows = found.filter(F.col("piece") == WHOLE).select("value").union(joined.filter("not header").select("value"))
    return rows.select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value <> ''")


def quoted_rows(spark: SparkSession, path: str, names: list[str], options: dict) -> DataFrame:
    """All files' records as text columns ``names``."""
    shape = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv("value", shape, {k: str(v) for k, v in options.items()})
    return records(spark, path).select(row.alias("row")).select("row.*").toDF(*names)
