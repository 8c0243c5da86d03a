"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often over the corpus.

Vocabulary A is a byte-level BPE file of the tokenizers library, B a
sentencepiece model that puts a space before a text. Both encode a space and
the text, so their tokens cover the same bytes; offsets where tokens of both
end cut the text into groups. An A and a B occurrence that end together are a
link, and the ids of a link are a pair.

Identity path: a map gives each A id the B id of the same bytes. Groups of one
A and one B token that the map holds are counted in vectors as long as the
vocabulary, which are added up position by position. Only links of other
groups enter the shuffle of pairs.

Counts go back to documents the same way. The vectors and the pairs that make
up at least 1 in ``FREQUENT`` of all links (so at most that many) go to all
tasks; only rarer links of a document are joined to their counts, and none of
those is frequent enough to be a hot key.

Texts are cut where a space follows another character: both vocabularies start
a token there (A's pre-tokens do; no B piece holds a space behind another
character, which is checked). Alignments of short pieces are kept in a bounded
table per worker. If a piece's bytes differ, the whole text is encoded anew.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.bpe import byte_characters
from cellwarden.llm.common import in_batches, stored
from cellwarden.llm.merge_replay import Table, chunks, groups

FREQUENT = 1 << 17
KEPT_LENGTH = 64
COUNTED = 500_000  # distinct pairs counted in a task before they are handed on
SPACE = "▁"


class Vocabularies:
    """Both tokenizers, the bytes of their tokens and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        of_char = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.n_b = len(pieces)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)  # a space only begins a piece
        self.blank = self.b.piece_to_id(SPACE)
        by_bytes: dict[bytes, int] = {}
        for i, token in enumerate(self.bytes_b):
            if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                if token not in by_bytes or self.b.is_byte(by_bytes[token]):  # a byte's own piece only if nothing else spells it
                    by_bytes[token] = i
        self.same = np.array([by_bytes.get(t, -1) if t else -1 for t in self.bytes_a], np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of a space and the text by A, and of the text by B, which adds the space itself."""
        of_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        of_b = self.b.encode(texts, num_threads=1)
        for text, a, b in zip(texts, of_a, of_b, strict=True):
            yield a.ids, b if text else [self.blank]  # but not to an empty text

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """(n_a, n_b, n_groups, groups, A ids of identity groups, pairs of other links); None if the bytes differ."""
        of_a, of_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if not (b"".join(of_a) == b"".join(of_b) == (" " + text).encode("utf-8", "surrogatepass")):
            return None
        groups, same, other = [], array("I"), array("Q")
        i = j = from_i = from_j = end_a = end_b = 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a += len(of_a[i])
                i += 1
            else:
                end_b += len(of_b[j])
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
                if i - from_i == 1 and j - from_j == 1 and self.same[a[from_i]] == b[from_j]:
                    same.append(a[from_i])
                else:
                    other.append(a[i - 1] * self.n_b + b[j - 1])
                from_i, from_j = i, j
        return len(a), len(b), len(groups), ";".join(groups), same.tobytes(), other.tobytes()


@lru_cache(1)
def of_files(path_a: str, path_b: str) -> Vocabularies:
    """The worker's vocabularies, loaded once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Vocabularies(path_a, path_b)


_NONE = (0, 0, 0, "", b"", b"")


class Aligner:
    """Alignments of texts by way of their pieces."""

    def __init__(self, vocabularies: Vocabularies):
        self.v, self.known = vocabularies, Table()

    def of_texts(self, texts: list[str]) -> list[tuple]:
        """As ``Vocabularies.aligned`` for whole texts; a text without tokens has zeros and empty values."""
        self.known.turn()
        if self.v.cuts:  # pieces without the space that each begins with
            pieces = [chunks(" " + t)[1] if t else [] for t in texts]
        else:
            pieces = [[t] if t else [] for t in texts]
        fresh = list(set().union(*pieces).difference(self.known, self.known.old))
        for at in range(0, len(fresh), 4096):
            part = fresh[at:at + 4096]
            for p, (a, b) in zip(part, self.v.encode(part), strict=True):
                self.known[p] = self.v.aligned(p, a, b)
        out = [self.whole(t, list(map(self.known.__getitem__, ps))) for t, ps in zip(texts, pieces, strict=True)]
        for p in fresh:
            if len(p) > KEPT_LENGTH:
                del self.known[p]
        return out

    def whole(self, text: str, found: list) -> tuple:
        if not found:
            return _NONE
        if None in found:
            return next((self.v.aligned(text, a, b) for a, b in self.v.encode([text])), None) or _NONE
        n_a, n_b, n_groups, groups, same, other = zip(*found, strict=True)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(same), b"".join(other)


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner, which keeps its table from task to task."""
    return Aligner(of_files(path_a, path_b))


def _counted(values: bytes, kind) -> tuple[bytes, bytes]:
    """Distinct values and how often each occurs."""
    found, n = np.unique(np.frombuffer(values, kind), return_counts=True)
    return found.tobytes(), n.astype(np.uint32).tobytes()


def alignments(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the links by id.

    ``same`` (A ids of identity groups) and ``other`` (A id x size of B + B id)
    are distinct values with their numbers in ``same_n`` and ``other_n``, as
    little-endian uint32, uint64 and uint32. ``with_groups`` adds the groups'
    text ``a1,a2|b1;a3|b2`` itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for part in groups(batch):
                found = aligner.of_texts([t.as_py() or "" for t in part.column("text")])
                same = [_counted(f[4], np.uint32) for f in found]
                other = [_counted(f[5], np.uint64) for f in found]
                sha = [hashlib.sha256(f[3].encode()).hexdigest() if f[3] else "" for f in found]
                columns = [part.column("doc_id"), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)),
                           pa.array([len(f[4]) // 4 + len(f[5]) // 8 for f in found], pa.int64()), pa.array(sha, pa.string()),
                           *(pa.array([x[i] for x in xs], pa.binary()) for xs in (same, other) for i in (0, 1))]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "other", "other_n"]
                if with_groups:
                    columns.append(pa.array([f[3] for f in found], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "same binary, same_n binary, other binary, other_n binary")
    return in_batches(rows, run, schema + (", groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Links of each pair over the corpus: (a, n) of identity pairs, and (pair, n) of all others, pair = A id x size of B + B id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(of_files(path_a, path_b).bytes_a), np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def summed():
            key = np.concatenate([k for k, _ in pairs] or [np.zeros(0, np.uint64)])
            n = np.concatenate([c for _, c in pairs] or [np.zeros(0, np.uint32)])
            found, place = np.unique(key, return_inverse=True)
            return found, np.bincount(place, n, len(found)).astype(np.int64)

        def rows(a, pair, n):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(pair, pa.int64()), pa.array(n, pa.int64())],
                                              names=["a", "pair", "n"])

        for batch in batches:
            for same, same_n, other, other_n in zip(*(batch.column(c) for c in ("same", "same_n", "other", "other_n")), strict=True):
                vector[np.frombuffer(same.as_py(), np.uint32)] += np.frombuffer(same_n.as_py(), np.uint32)
                if other.as_py():
                    pairs.append((np.frombuffer(other.as_py(), np.uint64), np.frombuffer(other_n.as_py(), np.uint32)))
                    held += len(pairs[-1][0])
            if held > 4 * COUNTED:
                pairs = [summed()]
                held = len(pairs[0][0])
                if held > COUNTED:
                    yield rows([None] * held, pairs[0][0].astype(np.int64), pairs[0][1])
                    pairs, held = [], 0
        key, n = summed()
        yield rows([None] * len(key), key.astype(np.int64), n)
        at = np.flatnonzero(vector)
        yield rows(at, [None] * len(at), vector[at])

    parts = stored(in_batches(aligned.select("same", "same_n", "other", "other_n"), run, "a long, pair long, n long"), "counts")
    identity = parts.filter("a is not null").groupBy("a").agg(F.sum("n").alias("n"))
    return identity, parts.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``.

    A pair's count is its number of links in the whole table. count_sum adds
    the counts of a row's links, n_best counts links whose pair no other pair
    of the same B id exceeds. ``path_a`` and ``path_b`` are files on every
    executor.

    * A null or empty text, or one that either vocabulary cannot spell byte by
      byte (so one that holds U+2581), has no tokens: zeros and an empty digest.
    * Whole texts of any length; strings of special tokens are plain text.
    * Rows are answered one by one, and repeated rows count repeatedly; null
      ids and extra columns change nothing; an empty table gives an empty result.
    """
    vocabularies = Vocabularies(path_a, path_b)
    same_b, n_b = vocabularies.same, vocabularies.n_b
    rows = stored(alignments(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    identity, others = pair_counts(rows, path_a, path_b)
    others = stored(others, "pairs")
    total = rows.agg(F.sum("n_links")).first()[0] or 0

    # All of these are as long as a vocabulary, or hold at most FREQUENT pairs.
    count_a = np.zeros(len(same_b), np.int64)
    for r in identity.collect():
        count_a[r["a"]] = r["n"]
    best_b = np.zeros(n_b, np.int64)
    for r in others.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("n")).collect():
        best_b[r["b"]] = r["n"]
    used = count_a > 0
    np.maximum.at(best_b, same_b[used], count_a[used])
    frequent = others.filter(F.col("n") * FREQUENT >= total).collect()
    pair = np.array([r["pair"] for r in frequent], np.int64)
    order = np.argsort(pair)
    pair, count = pair[order], np.array([r["n"] for r in frequent], np.int64)[order]
    best_a = used & (count_a == best_b[same_b])
    shared = rows.sparkSession.sparkContext.broadcast((count_a, best_a, pair, count, count == best_b[pair % n_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_a, best_a, pair, count, best = shared.value
        for batch in batches:
            sums, bests, rare, rare_n = [], [], [], []
            for same, same_n, other, other_n in zip(*(batch.column(c) for c in ("same", "same_n", "other", "other_n")), strict=True):
                a, n = np.frombuffer(same.as_py(), np.uint32), np.frombuffer(same_n.as_py(), np.uint32).astype(np.int64)
                p, m = np.frombuffer(other.as_py(), np.uint64).astype(np.int64), np.frombuffer(other_n.as_py(), np.uint32).astype(np.int64)
                at = np.searchsorted(pair, p)
                here = at < len(pair)
                here[here] = pair[at[here]] == p[here]
                at = at[here]
                sums.append(int(n @ count_a[a] + m[here] @ count[at]))
                bests.append(int(n @ best_a[a] + m[here] @ best[at]))
                rare.append(p[~here])
                rare_n.append(m[~here])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64()))],
                names=["row", "n_best", "count_sum", "rare", "rare_n"])

    sums = stored(in_batches(rows.select("row", "same", "same_n", "other", "other_n"), run,
                             "row long, n_best long, count_sum long, rare array<long>, rare_n array<long>"), "sums")
    links = sums.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("pair"), F.col("r.rare_n").alias("times"))
    top = others.filter(F.col("n") * FREQUENT < total).withColumn("b", F.col("pair") % n_b)
    highest = rows.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(best_b) if n], "b long, top long")
    rare = top.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    of_rare = links.join(rare, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    found = sums.select("row", "n_best", "count_sum").join(of_rare, "row", "left")
    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return rows.drop("same", "same_n", "other", "other_n").join(found, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
