"""Benchmark decontamination: a positional inverted index of the corpus, phrase and proximity search.

The index holds postings (term, document, position) of the corpus. A phrase
search opens the lists of the rarest terms of each test window only, so only
terms that are among the ``RAREST`` of some window are stored; rarity is the
exact count over the whole corpus. A posting is shifted by the place of its
term in the test item: equal shifts mean that document and item run in step.
Shifts met by enough of the anchors are read out in full against the
document's words, and runs of equal words that hold a whole window are hits.

The same postings answer proximity: an item is near where its rarest terms lie
close together and a span little longer than the item holds all its words, in
any order, so passages with words put in, moved or repeated are found.

Everything is DataFrame functions. Terms travel as 64-bit hashes; the final
comparison is made on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwarden.llm.common import small, stored, text_key

WINDOW = 10
RAREST = 3
SLACK = 5  # a proximity match may be longer than its item by a word for every so many
# All that is not a digit, a letter or beyond ASCII parts words.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(word: Column) -> Column:
    """A-Z in lower case, nothing else; ``lower`` does just that to pure ASCII."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Words of a whole text in their case; the first or last entry may be empty."""
    return F.split(F.coalesce(text, F.lit("")), _GAP, -1)


def word_count(parts: Column) -> Column:
    """Number of words among ``words``."""
    empty = F.lit("")
    return (F.size(parts) - (parts[0] == empty).cast("int")
            - ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == empty)).cast("int")).cast("long")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, pos, word): every word of every text in lower case; positions count from the text's start."""
    each = docs.select("doc_id", text_key(F.col("text")).alias("hash"), F.posexplode(words(F.col("text"))).alias("pos", "raw"))
    return each.filter("raw <> ''").select("doc_id", "hash", "pos", _lower(F.col("raw")).alias("word"))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, place, word, n): the words of each distinct test text, counted from 0."""
    of_item = Window.partitionBy("item_id", "copy")
    each = (items.select("item_id", F.xxhash64("text").alias("copy"), "text").distinct()
            .select("item_id", "copy", F.posexplode(words(F.col("text"))).alias("at", "raw")).filter("raw <> ''"))
    return each.select(
        "item_id", "copy", (F.row_number().over(of_item.orderBy("at")) - 1).alias("place"),
        _lower(F.col("raw")).alias("word"), F.count("*").over(of_item).cast("int").alias("n"))


def corpus_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, freq) of the vocabulary's terms over the whole corpus; others are counted and dropped."""
    counts = tokens(docs).select(F.xxhash64("word").alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    return vocabulary.join(counts, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def anchors(test_words: DataFrame, counts: DataFrame, window: int, rarest: int) -> DataFrame:
    """(item_id, copy, place, term, freq): the words among the ``rarest`` of some window of their item.

    A word is ranked inside each window that holds it, ties by place.
    """
    ranked = test_words.join(counts, "term")
    starts = ranked.withColumn("start", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("place") - (window - 1)),
        F.greatest(F.lit(0), F.least(F.col("place"), F.col("n") - window)))))
    rank = F.row_number().over(Window.partitionBy("item_id", "copy", "start").orderBy("freq", "place"))
    return (starts.withColumn("rank", rank).filter(F.col("rank") <= rarest)
            .select("item_id", "copy", "place", "term", "freq").distinct())


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index (term, doc_id, hash, pos), for the terms that some search opens."""
    hits = tokens(docs).select(F.xxhash64("word").alias("term"), "doc_id", "hash", "pos").join(
        small(terms.select("term").distinct()), "term")
    return stored(hits, "postings")


def aligned(index: DataFrame, chosen: DataFrame, test_sizes: DataFrame, rarest: int) -> DataFrame:
    """(doc_id, hash, item_id, copy, shift) at which enough anchors of an item fall on their places."""
    shifted = index.join(small(chosen), "term").select(
        "doc_id", "hash", "item_id", "copy", (F.col("pos") - F.col("place")).alias("shift"), "place")
    # Repeated rows of a document give equal postings: count places, not postings.
    met = shifted.groupBy("doc_id", "hash", "item_id", "copy", "shift").agg(F.countDistinct("place").alias("met"))
    return (met.join(small(test_sizes), ["item_id", "copy"])
            .filter(F.col("met") >= F.least(F.lit(rarest), F.col("n"))).drop("met", "n"))


class Search:
    """What both searches read: the items' words and sizes, their anchors, and the stored postings of the anchors."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST):
        test = stored(item_words(items).withColumn("term", F.xxhash64("word")), "test_words")
        self.docs, self.test, self.window, self.rarest = docs, test, window, rarest
        self.sizes = test.groupBy("item_id", "copy").agg(F.max("n").alias("n"))
        counts = corpus_counts(docs, test.select("term").distinct())
        self.anchors = stored(anchors(test, counts, window, rarest), "anchors")
        self.index = postings(docs, self.anchors)


def phrase_hits(search: Search) -> DataFrame:
    """(doc_id, hash, item_id, from, to): runs of words that hold a whole window of an item.

    ``to`` is exclusive; positions are those of ``tokens``. Items of fewer
    words than the window, but not none, are one window.
    """
    docs, test, window, rarest = search.docs, search.test, search.window, search.rarest
    found = aligned(search.index, search.anchors, search.sizes, rarest)

    full = docs.select(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("h"), F.col("text"))
    texts = test.groupBy("item_id", "copy").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("wanted"))
    found = small(stored(found, "aligned"))
    read = full.join(found, found["doc_id"].eqNullSafe(full["d"]) & (found["hash"] == full["h"])).join(small(texts), ["item_id", "copy"])
    # The document's words from the shift on, null where the item hangs over an end.
    have = F.slice(F.col("parts"), F.greatest(F.col("shift"), F.lit(0)) + 1,
                   F.size("wanted") + F.least(F.col("shift"), F.lit(0)))
    have = F.concat(F.array_repeat(F.lit(None).cast("string"), -F.least(F.col("shift"), F.lit(0))), have)
    same = F.zip_with("wanted", have, lambda a, b: a.eqNullSafe(_lower(b)))
    flags = read.withColumn("parts", words(F.col("text"))).select(
        "doc_id", "hash", "item_id", "copy", "shift", F.size("wanted").alias("n"), F.posexplode(same).alias("place", "same"))
    equal = flags.filter("same").distinct()
    line = Window.partitionBy("doc_id", "hash", "item_id", "copy", "shift").orderBy("place")
    runs = (equal.withColumn("island", F.col("place") - F.row_number().over(line))
            .groupBy("doc_id", "hash", "item_id", "copy", "shift", "n", "island")
            .agg(F.min("place").alias("lo"), (F.max("place") + 1).alias("hi")))
    whole = runs.filter(F.col("hi") - F.col("lo") >= F.least(F.lit(window), F.col("n")))
    return whole.select("doc_id", "hash", "item_id", (F.col("shift") + F.col("lo")).alias("from"),
                        (F.col("shift") + F.col("hi")).alias("to")).distinct()


def covered(hits: DataFrame) -> DataFrame:
    """(doc_id, hash, n_hit, items): words inside any hit and the items hit, per document."""
    before = F.max("to").over(Window.partitionBy("doc_id", "hash").orderBy("from", "to", "item_id")
                              .rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("to") - F.greatest(F.col("from"), F.coalesce(before, F.lit(-1))))
    items = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    return (hits.withColumn("fresh", fresh).groupBy("doc_id", "hash")
            .agg(F.sum("fresh").cast("long").alias("n_hit"), items.alias("items")))


def plain(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with just the columns searched."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
            items.select("item_id", F.col("text").cast("string").alias("text")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """doc_id, hash, n_words, n_hit, n_items, items, contaminated for each row of ``docs``.

    * Null, empty or wordless texts have no words and no hits; so have items.
    * An item with a null id is searched but cannot be named: its hits count
      as words hit, not as an item.
    * Repeated rows are answered alike, each with its own result row.
    * Several texts under one item_id are all searched as that item.
    * An empty table on either side gives no hits; extra columns are ignored.
    """
    docs, items = plain(docs, items)
    return answered(Search(docs, items, window, rarest))


def answered(search: Search) -> DataFrame:
    """The result of ``decontaminate`` from a search at hand."""
    docs = search.docs
    hits = covered(phrase_hits(search))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "n_hit", "items")
    # The hash of the text lets a null id and a reused id find their own row.
    rows = docs.select("doc_id", text_key(F.col("text")).alias("hash"), word_count(words(F.col("text"))).alias("n_words"))
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["d"]) & (rows["hash"] == hits["h"]), "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "hash", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
                      found.alias("items"), (n_hit > 0).alias("contaminated"))


def _spans(seen: DataFrame, of: list[str], rarest: int) -> DataFrame:
    """Columns ``of``, need, from, to: for each posting the shortest span that ends there and holds all the ``need`` slots."""
    line = Window.partitionBy(*of).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    slots = range(1, rarest + 1)
    last = [F.last(F.when(F.col("slot") == i, F.col("pos")), ignorenulls=True).over(line).alias(f"at_{i}") for i in slots]
    met = sum((F.col(f"at_{i}").isNotNull().cast("int") for i in slots), F.lit(0))
    start = F.array_min(F.array(*[f"at_{i}" for i in slots]))
    rest = [c for c in seen.columns if c not in (*of, "pos", "slot", "term")]
    return (seen.select(*of, "pos", *rest, *last).filter(met == F.col("need"))
            .select(*of, *rest, start.alias("from"), (F.col("pos") + 1).alias("to")))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, rarest: int = RAREST) -> DataFrame:
    """(doc_id, hash, item_id, from, to): spans of at most ``slop`` words with an item's ``rarest`` distinct terms in any order.

    Each span ends at a posting and takes, for every term, its last posting
    before; the span is as short as that end allows.
    """
    test = item_words(items).withColumn("term", F.xxhash64("word"))
    counts = corpus_counts(docs, test.select("term").distinct())
    ranked = test.join(counts, "term").groupBy("item_id", "term").agg(F.min("freq").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("freq", "term"))
    terms = stored(ranked.withColumn("slot", rank).filter(F.col("slot") <= rarest).select("item_id", "term", "slot"), "terms")
    need = terms.groupBy("item_id").agg(F.max("slot").alias("need"))
    seen = postings(docs, terms).distinct().join(small(terms), "term").join(small(need), "item_id")
    spans = _spans(seen, ["doc_id", "hash", "item_id"], rarest)
    return spans.filter(F.col("to") - F.col("from") <= slop).select("doc_id", "hash", "item_id", "from", "to")


def near_matches(search: Search, slack: int = SLACK) -> DataFrame:
    """(doc_id, hash, item_id, from, to): spans of a document that hold all distinct words of an item.

    A span may have n + max(1, n / ``slack``) words for an item of n. The
    rarest anchors of the item, found close together, propose it from the
    postings of the phrase search; the document's words around them confirm
    that some span of that length holds every word of the item. ``from`` and
    ``to`` are those of the anchors. No anchor, no match is lost: the anchors
    are words of the item too.
    """
    by_item = Window.partitionBy("item_id", "copy")
    terms = search.anchors.groupBy("item_id", "copy", "term").agg(F.min("freq").alias("freq"), F.min("place").alias("place"))
    terms = terms.withColumn("slot", F.row_number().over(by_item.orderBy("freq", "place"))).filter(F.col("slot") <= search.rarest)
    terms = terms.withColumn("need", F.max("slot").over(by_item)).join(search.sizes, ["item_id", "copy"])
    most = F.col("n") + F.greatest(F.lit(1), F.floor(F.col("n") / slack).cast("int"))
    # Slots met, and above them how many there are: one number that can be or-ed.
    mark = F.expr("shiftleft(1L, slot - 1) | shiftleft(cast(need AS bigint), 32)")
    terms = stored(terms.select("item_id", "copy", "term", "slot", "need", most.alias("most"), mark.alias("mark")), "slots")
    of = ["doc_id", "hash", "item_id", "copy"]
    seen = search.index.join(small(terms), "term").withColumn("pair", F.xxhash64(*of))
    # Two numbers for each document and item with any slot find the pairs with all of them; equal hashes only add pairs.
    met = seen.groupBy("pair").agg(F.bit_or("mark").alias("mark"))
    met = stored(met.filter("(mark & 4294967295L) = shiftleft(1L, cast(shiftright(mark, 32) AS int)) - 1").select("pair"), "met")
    seen = seen.join(small(met), "pair", "left_semi").drop("pair", "mark")
    spans = _spans(seen, of, search.rarest).filter(F.col("to") - F.col("from") <= F.col("most"))
    # All spans of an item in one document: at most one for each of its words.
    spans = spans.groupBy(*of, "most").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    wanted = search.test.groupBy("item_id", "copy").agg(F.collect_set("word").alias("wanted"))
    full = search.docs.select(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("h"), "text")
    # Few documents are proposed: where these are measured to be small, no text is shuffled.
    read = small(stored(spans, "near"))
    read = full.join(read, read["doc_id"].eqNullSafe(full["d"]) & (read["hash"] == full["h"])).join(small(wanted), ["item_id", "copy"])

    def holds(span: Column) -> Column:
        low = F.greatest(F.lit(0), span["to"] - F.col("most"))
        near = F.transform(F.slice(F.col("parts"), low + 1, span["from"] + F.col("most") - low), _lower)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(near) - F.col("most") + 1))
        return F.exists(starts, lambda s: F.size(F.array_except("wanted", F.slice(near, s, F.col("most")))) == 0)

    held = F.explode(F.filter("spans", holds)).alias("span")
    return read.withColumn("parts", words(F.col("text"))).select("doc_id", "hash", "item_id", held).select(
        "doc_id", "hash", "item_id", "span.from", "span.to").distinct()


def searched(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, slack: int = SLACK) -> DataFrame:
    """``decontaminate`` with near_items as well: the ids, as sorted strings, of the items near in each row.

    Nulls, empty texts, repeated rows and empty tables as there; an item with
    a null id is in no list. ``contaminated`` follows the exact windows alone.
    """
    search = Search(*plain(docs, items), window, rarest)
    near = near_matches(search, slack).groupBy("doc_id", "hash").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("near_items"))
    near = near.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "near_items")
    out = answered(search)
    none = F.array().cast("array<string>")
    return (out.join(near, out["doc_id"].eqNullSafe(near["d"]) & (out["hash"] == near["h"]), "left")
            .select(*[out[c] for c in out.columns], F.coalesce("near_items", none).alias("near_items")))
