"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split where a space follows a character that is no space: the
pre-tokenizer always starts a new piece there, so the counts of the pieces add
up to the count of the text. Pieces seen before are looked up; the others are
encoded by the library in batches of about ``BATCH_BYTES``, whatever the sizes
of the texts they come from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import in_batches

LIMIT = 1024
BATCH_BYTES = 1 << 20
KEPT = 400_000  # pieces remembered per worker
KEPT_LENGTH = 64

_SAFE = re.compile(r"(?<=\S)(?= )")


@lru_cache(1)
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def counts(texts: list[str], tokenizer, known: dict[str, int]) -> list[int]:
    """Token counts of whole texts; ``known`` keeps lengths of short pieces."""
    pieces = [_SAFE.split(t) if t else [] for t in texts]
    fresh = list(dict.fromkeys(p for ps in pieces for p in ps if p not in known))
    lengths: dict[str, int] = {}
    batch, size = [], 0

    def flush():
        for p, e in zip(batch, tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            lengths[p] = len(e)

    for p in fresh:
        batch.append(p)
        size += len(p)
        if size >= BATCH_BYTES:
            flush()
            batch, size = [], 0
    if batch:
        flush()
    if len(known) + len(lengths) > KEPT:
        for p in {p for ps in pieces for p in ps if p in known}:
            lengths[p] = known[p]
        known.clear()
    known.update(lengths)
    out = [sum(map(known.__getitem__, ps)) for ps in pieces]
    for p in lengths:
        if len(p) > KEPT_LENGTH:
            del known[p]
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Counts are those of the library for ``vocabulary`` (a byte-level BPE file
    that every executor has) without added special tokens; special strings in
    a text are handled as by its default.

    * A null or empty text has no bytes and no tokens.
    * Rows are counted one by one: repeated rows, null ids, extra columns and
      an empty table need nothing special; texts are counted whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        tokenizer, known = _library(vocabulary), {}
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            sizes, n = [len(t.encode("utf-8", "surrogatepass")) for t in texts], []
            at = 0
            while at < len(texts):  # groups of texts balanced by bytes
                end, total = at + 1, sizes[at]
                while end < len(texts) and total < 4 * BATCH_BYTES:
                    total += sizes[end]
                    end += 1
                n += counts(texts[at:end], tokenizer, known)
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
