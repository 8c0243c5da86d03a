"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op4_minhash_neardup(spark, sf_dir):
    from cellwarden.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("hash")


@query(r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
ds AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM w, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM ds),
hit AS (SELECT doc_id, item_id, s, k FROM dw JOIN bw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id),
bt AS (SELECT item_id, len(w) + greatest(1, len(w) // 5) AS most, len(list_distinct(w)) AS need, unnest(list_distinct(w)) AS word FROM b WHERE len(w) > 0),
dt AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
seen AS (SELECT doc_id, item_id, most, need, word, p FROM dt JOIN bt USING (word)
  QUALIFY count(DISTINCT word) OVER (PARTITION BY doc_id, item_id) = need),
spans AS (SELECT x.doc_id, x.item_id, x.p FROM seen x JOIN seen y
  ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND y.p <= x.p AND y.p > x.p - x.most
  GROUP BY x.doc_id, x.item_id, x.p, x.need HAVING count(DISTINCT y.word) = x.need),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near_ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM spans) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(near_ids, '') AS near_items
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
""")
def op2_decontamination(spark, sf_dir):
    """Exact windows, and in n_near and near_items the items all of whose words lie close together."""
    from cellwarden.llm.decontaminate import searched

    found = searched(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("long").alias("n_near"), F.array_join("near_items", ",").alias("near_items"))


@query()
def op8_secret_scan(spark, sf_dir):
    from cellwarden.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
        F.col("all_spans").alias("spans"))


VOCABULARY = "byte_bpe_50k.json"


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query()
def op7_bpe(spark, sf_dir):
    from cellwarden.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), _vocabulary())


@query()
def op9_quality_fm(spark, sf_dir):
    from cellwarden.llm.quality_fm import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op1_quality_rules(spark, sf_dir):
    from cellwarden.llm.quality_rules import judge

    return judge(_table(spark, sf_dir, "documents")).drop("hash")


@query()
def op3_pii(spark, sf_dir):
    from cellwarden.llm.pii import scan

    return scan(_table(spark, sf_dir, "documents"))


@query()
def op5_token_counts(spark, sf_dir):
    from cellwarden.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary())


@query(r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m
""")
def op6_warc(spark, sf_dir):
    from cellwarden.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op10_license_scan(spark, sf_dir):
    """The documents as files ``source/lang/doc_id``."""
    from cellwarden.llm.license_scan import licenses

    docs = _table(spark, sf_dir, "documents")
    return licenses(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))


@query()
def op13_merge_replay(spark, sf_dir):
    import public_tokenizers

    from cellwarden.llm.merge_replay import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                   public_tokenizers.PATTERN)


@query()
def op11_token_alignment(spark, sf_dir):
    import public_tokenizers

    from cellwarden.llm.token_alignment import align

    return align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))


@query("""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op12_hard_negatives(spark, sf_dir):
    from cellwarden.llm.hard_negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))
