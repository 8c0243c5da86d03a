"""Byte-level BPE by corpus-level merge replay, for vocabularies given as ranks.

Pre-tokens ("words") repeat, so merges are replayed over distinct words. All
words of a replay lie in one array of tokens with links to both neighbours. An
inverted index leads from each mergeable token pair to its positions; pairs
that make the same token share a posting list, since a rank belongs to the
token made. Ranks are taken in ascending order; a merge touches only its two
neighbours, whose new pairs enter the index. A new pair may rank before the
merge just applied (a quarter of a public multilingual vocabulary allows it):
then the word's other positions wait until the lower rank is done, so that
each word sees its merges in exactly the order of a text encoded alone.

Words are counted over the whole corpus. Those that make up at least 1 in
``LEXICON`` of it (so no more than a small multiple of that many) are replayed
once, in hash partitions, and go to all tasks as a lexicon; the rest is
replayed batch by batch where it occurs, by the same code. The lexicon saves
work and decides nothing: results are the same without it.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import in_batches, stored, text_key

LEXICON = 1 << 16
WORD_BYTES = 64  # longer words are never kept
KEPT = 400_000  # words, and chunks, kept per worker and generation
REPLAY_BYTES = 1 << 20  # words replayed together; a longer word is alone
GROUP_BYTES = 4 << 20  # characters of texts whose new words are replayed together
COUNTED = 500_000  # distinct chunks counted in a task before they are handed on

_GLUED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


class Ranks:
    """A rank file: lines of base64 token and rank; the rank is the token's id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.size = max(self.rank.values()) + 2  # the last id stands for a word's end
        self.bytes_of = [b""] * (self.size - 1)
        for token, r in self.rank.items():
            self.bytes_of[r] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)])
        # The token that two neighbours make, for all pairs that make one.
        self.made = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    self.made[a * self.size + b] = r
        self.first = np.full((257, 257), -1, np.int64)  # the same for bytes; 256 is a word's end
        for x in range(256):
            for y in range(256):
                self.first[x, y] = self.made.get(int(self.byte[x] * self.size + self.byte[y]), -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (not empty)."""
        out = [[self.rank[w]] if w in self.rank else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        if not rest:
            return out
        ends = np.cumsum([len(words[i]) + 1 for i in rest]) - 1  # where each word's end mark lies
        data = np.full(int(ends[-1]) + 1, 256)
        data[data_places(ends)] = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)
        found = self.first[data[:-1], data[1:]]
        places = np.flatnonzero(found >= 0)
        places = places[np.argsort(found[places], kind="stable")]
        ranks, starts = np.unique(found[places], return_index=True)
        order, bounds = places.tolist(), [*starts.tolist(), len(places)]
        index = {r: order[bounds[k]:bounds[k + 1]] for k, r in enumerate(ranks.tolist())}

        token = np.append(self.byte, self.size - 1)[data].tolist()
        pair = [*found.tolist(), None]  # the token a position makes with its right neighbour
        self._merge(index, token, pair, ends)
        at = 0
        for i, stop in zip(rest, ends.tolist(), strict=True):
            out[i] = [t for t in token[at:stop] if t >= 0]
            at = stop + 1
        return out

    def _merge(self, index: dict[int, list[int]], token: list[int], pair: list, ends: np.ndarray) -> None:
        """Applies all merges; ``index`` holds the positions of each rank, ``ends`` the words' end marks."""
        heap = list(index)  # ascending, so a heap
        size, make, get = self.size, self.made.get, index.get
        # A word's end makes no token with anything; the last one also stands before the first word.
        after, before = list(range(1, len(token) + 1)), [len(token) - 1, *range(len(token) - 1)]
        while heap:
            rank = heappop(heap)
            stop, later, rank_first = -1, [], rank * size
            for p in sorted(index.pop(rank)):
                if pair[p] != rank:
                    continue
                if p < stop:
                    later.append(p)
                    continue
                q = after[p]
                token[p], token[q], pair[q] = rank, -1, None
                right = after[p] = after[q]
                before[right] = p
                low = False
                made = pair[p] = make(rank_first + token[right])
                if made is not None:
                    low = made < rank
                    places = get(made)
                    if places is None:
                        index[made] = [p]
                        heappush(heap, made)
                    else:
                        places.append(p)
                left = before[p]
                made = pair[left] = make(token[left] * size + rank)
                if made is not None:
                    low = low or made < rank
                    places = get(made)
                    if places is None:
                        index[made] = [left]
                        heappush(heap, made)
                    else:
                        places.append(left)
                if low:  # the word's other positions wait for the lower rank
                    stop = int(ends[np.searchsorted(ends, p)])
            if later:
                index[rank] = later
                heappush(heap, rank)

    def replayed(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of many words, replayed in groups of bounded size."""
        group, size = [], 0
        for w in words:
            group.append(w)
            size += len(w)
            if size >= REPLAY_BYTES:
                yield from zip(group, self.replay(group), strict=True)
                group, size = [], 0
        yield from zip(group, self.replay(group), strict=True)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def data_places(ends: np.ndarray) -> np.ndarray:
    """Places of all bytes of words whose end marks are at ``ends``."""
    inside = np.ones(int(ends[-1]) + 1, bool)
    inside[ends] = False
    return np.flatnonzero(inside)


@lru_cache(2)
def of_file(path: str) -> Ranks:
    """The worker's vocabulary, built once."""
    return Ranks(path)


def chunks(text: str) -> tuple[list[str], list[str]]:
    """A text cut before spaces that follow another character, where a word starts in any case.

    The first list has at most one chunk, which does not begin with a space;
    chunks of the second do, and come without it.
    """
    if not text:
        return [], []
    found = text.split(" ") if _GLUED.search(text) is None else [
        c[1:] if i else c for i, c in enumerate(_CUT.split(text))]
    if _GLUED.search(text) is None:
        return ([found[0]] if found[0] else []), found[1:]
    return ([found[0]], found[1:]) if text[0] != " " else ([], [found[0][1:], *found[1:]])


def corpus_words(docs: DataFrame, pattern: str) -> DataFrame:
    """(word binary, n): frequent pre-tokens of at most ``WORD_BYTES`` bytes in ``docs``(text); null counts all chunks.

    Every chunk of every text is counted. A chunk is handed on with its count
    where it makes up 1 in ``LEXICON`` of what a task has counted at a time;
    one that does so in the corpus does so somewhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, bare, spaced = regex.compile(pattern).findall, Counter(), Counter()

        def rows():
            total = sum(bare.values()) + sum(spaced.values())
            seen: Counter = Counter()
            for counted, space in ((bare, ""), (spaced, " ")):
                for chunk, n in counted.items():
                    if n * LEXICON >= total and len(chunk) <= WORD_BYTES:
                        for w in find(space + chunk):
                            seen[w] += n
                counted.clear()
            kept = [(e, n) for w, n in seen.items() if len(e := w.encode("utf-8", "surrogatepass")) <= WORD_BYTES]
            return pa.RecordBatch.from_arrays(
                [pa.array([None, *(w for w, _ in kept)], pa.binary()), pa.array([total, *(n for _, n in kept)], pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                first, others = chunks(text.as_py() or "")
                bare.update(first)
                spaced.update(others)
                if len(spaced) + len(bare) >= COUNTED:
                    yield rows()
        yield rows()

    counted = in_batches(docs.select(F.col("text").cast("string").alias("text")), run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def replay_words(words: DataFrame, ranks: str) -> DataFrame:
    """(word, ids: little-endian uint32) for each row of ``words``(word), merges replayed in each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = of_file(ranks)
        for batch in batches:
            found = list(vocabulary.replayed(w.as_py() for w in batch.column("word")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.binary()), pa.array([np.array(i, "<u4").tobytes() for _, i in found], pa.binary())],
                names=["word", "ids"])
    return in_batches(words.select("word").filter("length(word) > 0"), run, "word binary, ids binary")


def lexicon(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(word, ids) of the at most ``LEXICON`` words that make up 1 in ``LEXICON`` of the corpus each."""
    words = stored(corpus_words(docs, pattern), "words")
    total = words.filter("word is null").agg(F.sum("n")).first()[0] or 0
    return replay_words(words.filter(F.col("word").isNotNull() & (F.col("n") * LEXICON >= total)), ranks)


class Table(dict):
    """Entries in two generations: a full one becomes the old one, whose used entries return."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key):
        entry = self[key] = self.old[key]
        return entry

    def holds(self, key) -> bool:
        return key in self or key in self.old

    def turn(self) -> None:
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Texts to ids by way of their chunks and words; keeps bounded tables of both beside the lexicon."""

    def __init__(self, ranks: Ranks, pattern: str, known: Iterable[tuple[bytes, bytes]]):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.lexicon = {w.decode("utf-8", "surrogatepass"): self.entry(np.frombuffer(i, "<u4").tolist()) for w, i in known}
        self.words, self.bare, self.spaced = Table(), Table(), Table()

    def entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        """Number of ids, ids in decimal, decoded bytes."""
        return len(ids), ",".join(map(str, ids)), self.ranks.decode(ids)

    def cut(self, chunk: str, space: str) -> list[str]:
        """The words of a chunk; ASCII letters alone are one in any case."""
        return [space + chunk] if self.one_word and chunk.isascii() and chunk.isalpha() else self.find(space + chunk)

    @cached_property
    def one_word(self) -> bool:
        """Whether the pattern takes a space and letters as one word."""
        return self.find(" Word") == [" Word"] and self.find("Word") == ["Word"]

    def learn(self, wanted: list[tuple[Table, str, list[str]]]) -> None:
        """Entries of chunks; the words not seen before are replayed together."""
        cut = [(table, {c: self.cut(c, space) for c in chunks}) for table, space, chunks in wanted]
        fresh = list(dict.fromkeys(
            w for _, of in cut for ws in of.values() for w in ws if w not in self.lexicon and not self.words.holds(w)))
        as_bytes = [w.encode("utf-8", "surrogatepass") for w in fresh]
        for w, (_, ids) in zip(fresh, self.ranks.replayed(as_bytes), strict=True):
            self.words[w] = self.entry(ids)
        for table, of in cut:
            for c, ws in of.items():
                es = [self.lexicon.get(w) or self.words[w] for w in ws]
                table[c] = es[0] if len(es) == 1 else (
                    sum([e[0] for e in es]), ",".join([e[1] for e in es]), b"".join([e[2] for e in es]))
        for w, b in zip(fresh, as_bytes, strict=True):
            if len(b) > WORD_BYTES:
                del self.words[w]

    def entries(self, texts: list[str]) -> Iterator[list[tuple]]:
        """For each text the entries of its chunks; what is new in any of them is replayed together."""
        for table in (self.words, self.bare, self.spaced):
            table.turn()
        cut = [chunks(t) for t in texts]
        wanted = []
        for k, (table, space) in enumerate(((self.bare, ""), (self.spaced, " "))):
            new = set().union(*(both[k] for both in cut)).difference(table, table.old)
            wanted.append((table, space, list(new)))
        collects = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            self.learn(wanted)
        finally:
            if collects:
                gc.enable()
        for first, others in cut:
            yield [*map(self.bare.__getitem__, first), *map(self.spaced.__getitem__, others)]
        for table, _, new in wanted:
            for c in new:
                if len(c) > WORD_BYTES:
                    del table[c]


@lru_cache(1)
def _encoder(ranks: str, pattern: str, known) -> Encoder:
    """The worker's encoder of one lexicon (a broadcast), which keeps its tables from task to task."""
    return Encoder(of_file(ranks), pattern, known)


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``GROUP_BYTES`` of text."""
    sizes = np.cumsum([len(t.as_py() or "") for t in batch.column("text")])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _with_lexicon(docs: DataFrame, ranks: str, pattern: str):
    """The lexicon as a broadcast: at most ``LEXICON`` words of at most ``WORD_BYTES`` bytes."""
    rows = tuple((bytes(r["word"]), bytes(r["ids"])) for r in lexicon(docs, ranks, pattern).collect())
    return docs.sparkSession.sparkContext.broadcast(rows)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("hash"),
                       F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, hash (of the text), n_tokens, ids (binary, little-endian uint32), decoded (binary) for each row.

    ``ranks`` is a rank file on every executor, ``pattern`` cuts texts into
    words; each match is encoded by itself, without special tokens, and what
    no match covers has no ids.

    * A null or empty text has no ids and decodes to nothing.
    * Whole texts of any length; strings of special tokens are plain text.
    * Rows are answered one by one: repeated rows, null ids and extra columns
      change nothing; an empty table gives an empty result.
    """
    known = _with_lexicon(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern, known.value)
        for batch in batches:
            for part in groups(batch):
                found = list(encoder.entries([t.as_py() or "" for t in part.column("text")]))
                ids = [np.array(",".join([e[1] for e in f if e[0]]).split(",") if f else [], "<u4").tobytes() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("hash"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array([b"".join([e[2] for e in f]) for f in found], pa.binary())],
                    names=["doc_id", "hash", "n_tokens", "ids", "decoded"])

    return in_batches(_rows(docs), run, "doc_id long, hash long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256: ``encode`` in digests."""
    known = _with_lexicon(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern, known.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in groups(batch):
                counts, of_ids, of_text = [], [], []
                for found in encoder.entries([t.as_py() or "" for t in part.column("text")]):
                    counts.append(sum([e[0] for e in found]))
                    of_ids.append(sha(",".join([e[1] for e in found if e[0]]).encode()))
                    of_text.append(sha(b"".join([e[2] for e in found])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                     pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_batches(_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
