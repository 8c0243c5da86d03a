"""SHA-256 of large files, taken piece by piece.

A digest goes from block to block, but its state can be handed on: OpenSSL's
own functions keep it in a plain struct, which ``hashlib`` hides. Files are
read in splits and stored in pieces of ``PIECE`` bytes; round by round, each
file's next piece is one task's work, which starts from the state left by the
round before. No task reads or holds a whole file.

Splits come from the text reader, which opens whatever Spark opens: lines
parted by LF alone, their bytes as they are. It drops a byte order mark at the
start of a file and does not tell whether the last line ends; the file's length
does. Runs without any LF have to fit in a row.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 128 << 20  # bytes of a file that one task takes into its digest
ROW = 64 << 10  # bytes in a stored row; Parquet holds 100 of them at least before it ends a page
# Files that the text reader would unpack; they are not split anyway.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
BOM = b"\xef\xbb\xbf"

_CONTEXT = 256  # bytes kept for OpenSSL's SHA256_CTX, which takes 112
_LIBRARIES = ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.3.dylib")
_STATE = "file string, length long, done long, state binary, sha256 string"


@functools.cache
def library() -> ctypes.CDLL | None:
    """OpenSSL, if it still has the functions with an open state."""
    for find in (*_LIBRARIES, ctypes.util.find_library):
        name = find("crypto") if callable(find) else find
        try:
            found = ctypes.CDLL(name) if name else None
        except OSError:
            continue
        if hasattr(found, "SHA256_Update"):
            return found
    return None


class OpenDigest:
    """SHA-256 that goes on from the state of another."""

    def __init__(self, state: bytes | None = None):
        self.lib = library()
        if self.lib is None:
            raise RuntimeError("executors lack the libcrypto that the driver has")
        self.context = ctypes.create_string_buffer(state or b"", _CONTEXT)
        if state is None:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.context.raw, _CONTEXT))
        return out.raw.hex()


def is_large() -> Column:
    """Of a file source's rows: those of files to be read in pieces. Spark leaves out the other files before it opens them."""
    return (F.col("_metadata.file_size") > PIECE) & ~F.col("_metadata.file_name").rlike(PACKED)


def split_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, place, round, size, data): the bytes of large files in rows, by split and place in it."""
    at = lambda name: F.col(f"_metadata.file_{name}")
    lines = (spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).filter(is_large())
             .select(F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"), at("path").alias("file"),
                     at("block_start").alias("start"), at("block_length").alias("length")))
    piece, most = PIECE, ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, held = None, 0, bytearray()

        def row(size: int) -> pa.RecordBatch:
            nonlocal place
            file, start, length = split
            # A split's last line goes beyond its end, but not into a later round than the next split.
            turn = (start + min(place, length - 1)) // piece
            data = bytes(held[:size])
            out = pa.RecordBatch.from_pydict(
                {"file": [file], "start": [start], "place": [place], "round": [turn], "size": [len(data)], "data": [data]}, shape)
            place += len(data)
            del held[:size]
            return out

        shape = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("round", pa.int64()),
                           ("size", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            data, keys = batch.column("data"), [batch.column(c) for c in ("file", "start", "length")]
            lo = 0
            while lo < len(data):  # a task can hold several splits, one after the other
                now, hi = tuple(k[lo].as_py() for k in keys), len(data)
                if tuple(k[hi - 1].as_py() for k in keys) != now:
                    hi = next(i for i in range(lo, hi) if tuple(k[i].as_py() for k in keys) != now)
                if now != split:
                    if held:
                        yield row(len(held))
                    split, place = now, 0
                held += _joined(data.slice(lo, hi - lo))
                while len(held) >= most:
                    yield row(most)
                lo = hi
        if held:
            yield row(len(held))

    return lines.mapInArrow(run, "file string, start long, place long, round long, size long, data binary")


def _joined(values: pa.Array) -> memoryview:
    """The bytes of a column's rows, one after the other as they lie in memory."""
    kind = "q" if pa.types.is_large_binary(values.type) else "i"
    ends = memoryview(values.buffers()[1]).cast(kind)
    return memoryview(values.buffers()[2])[ends[values.offset]:ends[values.offset + len(values)]]


def _taken(batches: Iterator[pa.RecordBatch], resumed: bool) -> Iterator[pa.RecordBatch]:
    """States after a round: each file's row with its state comes first, then its bytes in order."""
    digest = file = None

    def ended() -> pa.RecordBatch:
        whole = done == length
        state = digest.state() if resumed and done else None
        return pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([length]), pa.array([done]), pa.array([state], pa.binary()),
             pa.array([digest.hexdigest() if whole else None], pa.string())],
            names=["file", "length", "done", "state", "sha256"])

    for batch in batches:
        for name, start, size, before, data in zip(
                *(batch.column(c) for c in ("file", "start", "length", "done", "data")), strict=True):
            data = data.as_py()
            if start.as_py() < 0:
                if file is not None:
                    yield ended()
                file, length, done = name.as_py(), size.as_py(), before.as_py()
                if done == 0 or not resumed:
                    digest, data = OpenDigest() if resumed else hashlib.sha256(), data or b""
                    digest.update(data)  # the byte order mark, if there was one
                    done = len(data)
                else:
                    digest = OpenDigest(data)
            else:
                data = data[:length - done]  # without the line end that the last line lacks
                digest.update(data)
                done += len(data)
    if file is not None:
        yield ended()


def large_files(spark: SparkSession, path: str, stored, resumed: bool | None = None) -> DataFrame:
    """(file, sha256) of the large files under ``path``.

    ``stored(df, name, *partitions)`` writes a table to a folder that all
    executors share, and reads it back. Without OpenSSL (``resumed`` False)
    one task takes a file's pieces one after the other, all of them.
    """
    if resumed is None:
        resumed = library() is not None
    pieces = stored(split_bytes(spark, path), "pieces", "round")
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(is_large())
              .select(F.col("_metadata.file_path").alias("file"), "length"))
    sizes = pieces.groupBy("file").agg(F.sum("size").alias("size"))
    over = F.col("size") - F.col("length")  # 1: the last line has no end; 3 fewer: a byte order mark was dropped
    misread = F.raise_error(F.concat(F.lit("not read as it is: "), F.col("file")))
    first = F.when(over.isin(0, 1), F.lit(None).cast("binary")).when(over.isin(-3, -2), F.lit(BOM)).otherwise(misread)
    states = listed.join(sizes, "file", "left").select(
        "file", "length", F.lit(0).cast("long").alias("done"), first.alias("state"), F.lit(None).cast("string").alias("sha256"))
    rounds = [F.col("round") == r["round"] for r in pieces.select("round").distinct().orderBy("round").collect()]
    none = F.lit(None).cast("long")
    for turn in rounds if resumed else [F.lit(True)]:
        before = states.select("file", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("place"),
                               "length", "done", F.col("state").alias("data"))
        data = pieces.filter(turn).select("file", "start", "place", none.alias("length"), none.alias("done"), "data")
        rows = before.union(data).repartition("file").sortWithinPartitions("file", "start", "place")
        states = stored(rows.mapInArrow(lambda batches: _taken(batches, resumed), _STATE), "states")
    return states.select("file", F.coalesce("sha256", misread).alias("sha256"))
