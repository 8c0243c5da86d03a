"""Helpers shared by the text operators: inputs, shared storage, word hashes, size checks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table, in bytes as measured, that a broadcast() here may send out.
BROADCAST_BYTES = 64 << 20

# Rows and bytes in an Arrow batch; a single longer text is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, under ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes are within ``limit``, else unchanged (a shuffled join)."""
    width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(8)) for c in df.columns), F.lit(16))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join of tables that both grow with the input: neither is ever broadcast.

    Spark judges a table by its files or by what goes into an explode, before lists unfold and columns are unpacked.
    """
    return df.hint("merge")


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches bounded by rows and bytes: texts can be long, and a batch lies in memory whole."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # -1 is no bound, and a unit is not read
            conf.set(name, str(most))
    return df.mapInArrow(run, schema)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of ``tables`` has it, in whatever case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """With the id it names a row; rows equal in both are the same document."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose (id, text) is in ``chosen``(k_id, k_hash)."""
    on = docs[doc_id].eqNullSafe(chosen["k_id"]) & (text_key(docs[text]) == chosen["k_hash"])
    return docs.join(chosen, on, "left_semi")


class WordHashes(dict):
    """64-bit hashes of words (bytes), each computed once; forgets all beyond ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words; a shorter text, unless empty, is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            out = (out ^ hashes[i:n - width + 1 + i]) * _MIX
            out ^= out >> _SHIFT
    return out
