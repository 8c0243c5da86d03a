"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality: documents the classifier rejects go.
2. neardup: one document of each group of near copies stays, the one with the
   least id; repeated rows of one document become one.
3. decontaminate: documents with a benchmark passage go.
4. secrets: every secret in a text is replaced by a mark.
5. encode: token ids of each text and their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.llm import bpe, decontaminate, neardup, quality_fm, secret_scan
from cellwarden.llm.common import keep_rows, shared_folder, shuffled, stored, unused
from cellwarden.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of at least 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = unused("k_score", docs)
    return quality_fm.scored(docs, quality_fm.fit(docs, labels), score).filter(F.col(score) >= 0.5).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; a document without words stands alone."""
    # Ids may repeat or be null, so kept can mark several texts of a group: the least (id, hash) of them stays.
    k_id, k_hash, k_rows = (unused(c, docs) for c in ("k_id", "k_hash", "k_rows"))
    found = neardup.grouped(docs).filter("kept").groupBy("component", "doc_id", "hash").agg(F.count("*").alias(k_rows))
    row = F.struct(F.col("doc_id").alias(k_id), F.col("hash").alias(k_hash), k_rows)
    of_group = found.filter("component is not null").groupBy("component").agg(F.min(row).alias("k")).select("k.*")
    chosen = stored(of_group.union(found.filter("component is null").select(row.alias("k")).select("k.*")), "chosen")
    on = docs["doc_id"].eqNullSafe(chosen[k_id]) & (F.xxhash64(docs["text"]) == chosen[k_hash])
    rows = docs.join(shuffled(chosen), on)
    if not chosen.filter(F.col(k_rows) > 1).isEmpty():  # repeated rows: only they need the shuffle
        rows = rows.filter(F.col(k_rows) == 1).union(rows.filter(F.col(k_rows) > 1).dropDuplicates([k_id, k_hash]))
    return rows.drop(k_id, k_hash, k_rows)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items).filter("not contaminated")
    return keep_rows(docs, found.select(F.col("doc_id").alias("k_id"), F.col("hash").alias("k_hash")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without secrets."""
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids with digests of ids and decoded text."""
    import public_tokenizers

    rows = bpe.encode(docs, public_tokenizers.path(VOCABULARY))
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("neardup", near_copies), ("decontaminate", benchmark), ("secrets", secrets),
          ("encode", encode)]

# The classifier's weights have no counterpart in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of ``documents``, each from its predecessor's files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
