"""Near duplicates: b-bit MinHash signatures, joined by a multi-index Hamming join, confirmed on full sets.

A document's set holds its distinct five-word shingles. A signature has 84
ten-bit MinHash values, six to a chunk. Two signatures that differ in fewer
than 2 x 14 values agree, by the pigeonhole principle, in all but at most one
value of some chunk: each chunk is therefore indexed once for every value left
out, and two documents that share such a key are candidates. This finds all
pairs within 27 differing values for certain; at similarity 0.75 a pair
misses all keys with a probability of 2e-5, and less above.

Candidates far apart (more than 44 of 84 values, which a pair of similarity
0.75 exceeds with a probability below 1e-7) are dropped, all others are
confirmed on the complete shingle sets of both texts.

Texts with equal sets form a class and only classes are joined. In a key's
bucket all members are first compared with the least one. Members of buckets that are not all linked
by that get an index of the rarest shingles of their full sets, which holds every pair that is similar
enough: sets whose rarest shingles no other has are out for certain. Members meet the most central
one of their shingle, and only pairs that are still apart then and can be similar by the places of their
first common shingle and by a parity of all are compared. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import ASCII_LOWER, WordHashes, in_batches, shuffled, stored, text_key, windows
from cellwarden.llm.components import components

WIDTH = 5
SHARE = 75  # percent of the union
CHUNKS, LANES, BITS = 14, 6, 10
GUARANTEED = 2 * CHUNKS - 1  # differing values up to which every pair shares a key
MARKS = 16  # longs with a bit for the parity of the shingles that fall on it
BLOCK = 400  # members outside a bucket's main component that are compared in one piece

_VALUES = CHUNKS * LANES
_RNG = np.random.Generator(np.random.PCG64(20240611))
_XOR = _RNG.integers(0, 2**64, _VALUES, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, _VALUES, dtype=np.uint64) | np.uint64(1)
_FINAL = np.uint64(0xD6E8FEB86659FD93)
_LANE = (1 << BITS) - 1
_PLACES = np.array([BITS * i for i in range(LANES)], np.uint64)


def shingle_set(text: str | None, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; fewer words make one shingle, none an empty set."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    return np.unique(windows(words.of(tokens), width))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``CHUNKS`` longs, each with ``LANES`` values of ``BITS`` bits."""
    least = np.full(_VALUES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            part = shingles[i:i + 4096]
            least = np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
        mixed = least ^ (least >> np.uint64(31))
        values = (mixed * _FINAL) >> np.uint64(64 - BITS)
    return (values.reshape(CHUNKS, LANES) << _PLACES).sum(axis=1).astype(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        words = WordHashes()
        for batch in batches:
            counts, names, signs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words, width)
                counts.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(counts, pa.int64()),
                 pa.array(names, pa.binary()), pa.array(signs, pa.list_(pa.int64()))],
                names=["doc_id", "hash", "n_shingles", "set_name", "signature"])
    return run


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, set_name (digest of the set) and signature for each row."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("hash"), "text")
    return in_batches(rows, _sketch(width), "doc_id long, hash long, n_shingles long, set_name binary, signature array<long>")


def distance(a: Column, b: Column) -> Column:
    """Number of values in which two signatures differ, counted lane by lane inside longs."""
    low = sum(((1 << (BITS - 1)) - 1) << (BITS * i) for i in range(LANES))
    high = sum(1 << (BITS * i + BITS - 1) for i in range(LANES))
    total = F.lit(0)
    for i in range(CHUNKS):
        x = a[i].bitwiseXOR(b[i])
        total = total + F.bit_count(((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x)).bitwiseAND(F.lit(high)))
    return total


def bucket_keys(classes: DataFrame) -> DataFrame:
    """(key, cid): every chunk of every signature, once for each value left out."""
    masks = F.array(*[F.lit(((1 << (BITS * LANES)) - 1) ^ (_LANE << (BITS * i))) for i in range(LANES)])
    each = classes.select("cid", "signature", F.explode(F.sequence(F.lit(0), F.lit(_VALUES - 1))).alias("i"))
    chunk = F.get("signature", F.floor(F.col("i") / LANES).cast("int"))
    return each.select(F.xxhash64("i", chunk.bitwiseAND(F.get(masks, F.col("i") % LANES))).alias("key"), "cid")


def _confirm(width: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept = WordHashes(), {}

        def of(cid, text):
            if cid not in kept:
                if len(kept) >= 128:
                    kept.clear()
                kept[cid] = shingle_set(text.as_py(), words, width)
            return kept[cid]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for x, y, tx, ty in zip(a, b, batch.column("text_a"), batch.column("text_b"), strict=True):
                s, t = of(x, tx), of(y, ty)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= share * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["u", "v"])
    return run


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, share: int) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) of classes that are similar enough on their full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(
        shuffled(classes.select("cid", "sample")), "cid")
    return _confirmed(pairs, _texts(wanted, docs), width, share)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    full = pairs.select("a", "b").join(shuffled(left), "a").join(shuffled(right), "b")
    return in_batches(full, _confirm(width, share), "u long, v long")


def _near(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    sizes = classes.select("cid", "n_shingles")
    a = sizes.select(F.col("cid").alias("a"), F.col("n_shingles").alias("n_a"))
    b = sizes.select(F.col("cid").alias("b"), F.col("n_shingles").alias("n_b"))
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return pairs.join(shuffled(a), "a").join(shuffled(b), "b").filter(100 * least >= share * most).select("a", "b")


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for cid, text in zip(batch.column("cid").to_pylist(), batch.column("text"), strict=True):
                s = shingle_set(text.as_py(), words, width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), cid, np.int64)), pa.array(np.full(len(s), len(s), np.int64)), pa.array(s)],
                    names=["cid", "n", "h"])
    return run


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, text) for the classes in ``wanted``(cid, sample)."""
    texts = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("hash"), "text")
    return (texts.join(shuffled(wanted), texts["doc_id"].eqNullSafe(wanted["sample.doc_id"])
                       & (texts["hash"] == wanted["sample.hash"]))
            .select("cid", "text").dropDuplicates(["cid"]))


def _labels(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) for every class, linked or not."""
    return stored(classes.select(F.col("cid").alias("node")).join(shuffled(found), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")), "labels")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links (u, v) between classes: components of components."""
    to = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    between = links.join(shuffled(to("u")), "u").join(shuffled(to("v")), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v"))
    above = components(between).select(F.col("node").alias("component"), F.col("component").alias("above"))
    return stored(labels.join(shuffled(above), "component", "left").select(
        "node", F.coalesce("above", "component").alias("component")), "labels")


def _prefixes(texts: DataFrame, width: int, share: int) -> DataFrame:
    """(h, cid, n, at, alone, marks): the shingles of each text's prefix that another text has too.

    n is the set's size, at the shingle's place, alone the number of shingles that no other text has, and
    marks the parities of the others: the bits in which two sets' marks differ are at most the shingles in which they do.

    A set's shingles stand in order of the number of ``texts``(cid, text) that have them, the rarest first. If the
    first one that two sets have in common stands at places i and j, they share at most min(n - i, m - j).
    Similar sets share ``share`` percent of either, so that a prefix of the others, plus one, holds that first one.
    """
    tokens = stored(in_batches(texts, _tokens(width), "cid long, n long, h long"), "shingles")
    common = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    mark = "bit_xor(if(shiftrightunsigned(h, 6) & {} = {}, shiftleft(1L, cast(h & 63 as int)), 0L))".format
    shared = tokens.join(shuffled(common), "h").groupBy("cid", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "h"))).alias("own"),
        F.array(*[F.expr(mark(MARKS - 1, i)) for i in range(MARKS)]).alias("marks"))
    alone = F.col("n") - F.size("own")  # those that no other text has come first
    most = F.floor(F.col("n") * (100 - share) / 100) + 1 - alone
    first = shared.select("cid", "n", alone.cast("long").alias("alone"), "marks",
                          F.slice("own", 1, F.greatest(most, F.lit(0)).cast("int")).alias("own"))
    return first.select("cid", "n", "alone", "marks", F.posexplode("own").alias("i", "s")).select(
        F.col("s.h").alias("h"), "cid", "n", (F.col("alone") + F.col("i")).alias("at"), "alone", "marks")


def _can_link(share: int) -> Column:
    """Of rows of two sides with one shingle: the sets may be similar if it is the first in common."""
    sizes = F.col("n_a") + F.col("n_b")
    both = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    differ = sum((F.bit_count(F.col("marks_a")[i].bitwiseXOR(F.col("marks_b")[i])) for i in range(MARKS)),
                 F.col("alone_a") + F.col("alone_b"))
    return ((100 * least >= share * most) & ((100 + share) * both >= share * sizes)
            & ((100 + share) * differ <= (100 - share) * sizes))


_ROW = ("cid", "n", "at", "alone", "marks", "component")


def _side(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in _ROW])


def _paired(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def _bucketed(prefixes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix rows with their components, and of buckets with several: the smallest set, the main component."""
    of = prefixes.join(shuffled(labels.select(F.col("node").alias("cid"), "component")), "cid")
    central = F.struct((F.col("at") / F.col("n")).alias("place"), *_ROW)
    each = of.groupBy("h", "component").agg(
        F.count("*").alias("rows"), F.min("n").alias("least"), F.min(central).alias("pivot"))
    buckets = each.groupBy("h").agg(
        F.count("*").alias("components"), F.min("least").alias("least"), F.min("pivot").alias("pivot"),
        F.max(F.struct("rows", "component"))["component"].alias("main"))
    return of, buckets.filter("components > 1")


def _pivot_pairs(of: DataFrame, buckets: DataFrame, share: int) -> DataFrame:
    """(a, b): each bucket's most central member, with the fewest rarer shingles, and members of other components."""
    pairs = _side(buckets.select("h", "pivot.*"), "a", "h").join(shuffled(_side(of, "b", "h")), "h")
    return _paired(pairs.filter("component_a <> component_b").filter(_can_link(share)))


def _rest_pairs(of: DataFrame, buckets: DataFrame, share: int) -> DataFrame:
    """(a, b): all pairs of different components that may be similar.

    Members of a bucket's main component do not meet each other, and rows too far back for its smallest set are out.
    More than ``BLOCK`` members of other components are dealt out, and each part meets the whole bucket.
    """
    fits = (100 + share) * (F.col("n") - F.col("at")) >= share * (F.col("n") + F.col("least"))
    rows = stored(of.join(shuffled(buckets.select("h", "least", "main")), "h").filter(fits)
                  .select("h", *_ROW, (F.col("component") == F.col("main")).alias("is_main")), "fitting")
    parts = rows.groupBy("h").agg(F.ceil(F.count_if(~F.col("is_main")) / BLOCK).alias("parts")).filter("parts > 0")
    rows = rows.join(shuffled(parts), "h")
    few = _side(rows.filter("not is_main").withColumn("part", F.pmod(F.xxhash64("cid"), "parts")), "a", "h", "part")
    whole = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    pairs = few.join(shuffled(_side(whole, "b", "h", "part", "is_main")), ["h", "part"])
    return _paired(pairs.filter("component_a <> component_b and (is_main or cid_a < cid_b)").filter(_can_link(share)))


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame,
            width: int, share: int) -> DataFrame:
    """Labels (node, component) after all links between components of buckets that hold several.

    All members of these buckets meet again on the shingles of their prefixes, which every similar
    pair shares: first with a bucket's most central member, then, where components are still apart, with each other.
    """
    of = labels.select(F.col("node").alias("cid"), "component")
    lead_of = labels.select(F.col("node").alias("lead"), F.col("component").alias("lead_component"))
    mixed = (members.join(shuffled(of), "cid").join(shuffled(lead_of), "lead").filter("component <> lead_component")
             .select("key").distinct())
    rows = members.join(shuffled(mixed), "key", "left_semi")
    side = stored(rows.select("cid").union(rows.select(F.col("lead"))).distinct(), "mixed")
    if side.isEmpty():
        return labels
    texts = stored(_texts(side.join(shuffled(classes.select("cid", "sample")), "cid"), docs), "texts")
    prefixes = stored(_prefixes(texts, width, share), "prefixes")
    for pairs_of in (_pivot_pairs, _rest_pairs):
        pairs = pairs_of(*_bucketed(prefixes, labels), share)
        links = stored(_confirmed(pairs, texts, width, share), "links")
        if not links.isEmpty():
            labels = _joined(labels, links)
    return labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """As ``grouped``, without the component."""
    return grouped(docs, width, share).drop("component")


def grouped(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """doc_id, hash, n_shingles, component, component_id, kept for each row of ``docs`` (doc_id, text).

    Links join rows whose sets meet 100 x intersection >= ``share`` x union;
    component_id is the least doc_id reachable, kept marks the rows that bear it.
    component tells groups apart whatever their ids are; it is null for an empty set.

    * A null, empty or blank text has an empty set and is linked with nothing:
      its component is itself and it is kept.
    * Fewer than ``width`` words: the whole sequence is one shingle.
    * A null doc_id links like others but never names a component unless all
      its members lack one; then component_id is null and kept is true.
    * Repeated rows are equal sets: each row is returned, with one answer.
    * An empty table gives an empty result; extra columns are ignored.
    * Whole texts of any length are used.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(sketches(docs, width), "sketches")
    classes = stored(
        rows.filter("n_shingles > 0").groupBy("set_name")
        .agg(F.min("doc_id").alias("name"), F.min(F.struct("doc_id", "hash")).alias("sample"),
             F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("n_shingles"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = bucket_keys(classes)
    leads = keys.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).filter("last > lead")
    members = stored(keys.join(shuffled(leads.select("key", "lead")), "key").filter("cid > lead"), "buckets")
    first = _near(members.select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct(), classes, share)
    labels = _labels(components(confirmed(first, classes, docs, width, share)), classes)
    labels = _across(members, labels, classes, docs, width, share)

    names = classes.join(shuffled(labels.withColumnRenamed("node", "cid")), "cid")
    least = names.groupBy("component").agg(F.min("name").alias("component_id"))
    of_set = names.select("set_name", "component").join(shuffled(least), "component").select("set_name", "component", "component_id")
    out = rows.select("doc_id", "hash", "n_shingles", "set_name").join(shuffled(of_set), "set_name", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "hash", "n_shingles", "component", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
