"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that can end its
encoding. An Aho-Corasick automaton of the vocabulary lists the tokens that
end at each place; the one whose pair with the last token of the prefix
before it is compatible is stored, and the ids are read off backwards. Two
tokens are compatible if no merge could have joined across their border
before they were complete, which is seen by undoing their merges from the
latest to the earliest.

Pre-tokens repeat, so each distinct one is encoded once and kept in a bounded
table per Python worker. Texts are encoded whole, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import in_batches

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 200_000  # pre-tokens remembered per worker and generation
KEPT_LENGTH = 64  # longer ones are encoded each time


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, more = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        chars = byte_characters()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.as_chars = dict(enumerate(chars))
        size = max(vocab.values()) + 1
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = [b""] * max(size, *(i + 1 for i in added.values()), 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [-1] * size  # the rank of the merge that makes a token
        self.halves: list[tuple[int, int]] = [(0, 0)] * size
        for r, (a, b) in enumerate(merges):
            i = vocab[a + b]
            if self.made[i] < 0:
                self.made[i], self.halves[i] = r, (vocab[a], vocab[b])
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if all(c in to_byte for c in token) and (len(token) == 1 or self.made[i] >= 0):
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.table = _Known(self)
        self.fits = lru_cache(1 << 17)(self._fits)

    def _fits(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side in an encoding.

        The later of the two tokens at the border is taken apart again and
        again; a merge of the two that ranks before the one just undone would
        have come first. Of equal ranks the left one does.
        """
        before = len(self.rank)
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            of_a, of_b = self.made[a], self.made[b]
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                before, a = of_a, self.halves[a][1]
            else:
                before, b = of_b + 1, self.halves[b][0]

    def pre_token(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        mapped = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.as_chars)
        n = len(mapped)
        last = [-1] * (n + 1)  # the token that ends the encoding of each prefix
        # Places come in order, at each the longest token first.
        for end, (length, token) in self.automaton.iter(mapped):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start == 0 or (last[start] >= 0 and self.fits(last[start], token)):
                    last[end + 1] = token
        out, at = [], n
        while at > 0:
            token = last[at]
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; special strings become their token."""
        if self.special is not None and any(s in text for s in self.added):
            out = []
            for i, part in enumerate(self.special.split(text)):
                out.append(np.uint32(self.added[part]).tobytes() if i % 2 else self._plain(part))
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids, invalid UTF-8 replaced."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


class _Known(dict):
    """Ids by pre-token, in two generations: a full one becomes the old one, whose used entries return."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or array("I", self.bpe.pre_token(piece)).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(1)
def of_file(path: str) -> Bpe:
    """The worker's encoder, built once."""
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, hash, n_tokens, ids (binary, little-endian uint32) and decoded (the ids' text) for each row.

    * A null or empty text has no ids and decodes to the empty text.
    * Whole texts of any length, without special tokens added; special
      strings inside a text become their token, as in the library.
    * Rows are answered one by one: repeated rows, null ids and extra columns
      change nothing; an empty table gives an empty result.
    ``vocabulary`` is the path of a byte-level BPE file on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of_file(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                texts = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("hash"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                    names=["doc_id", "hash", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"),
                       F.col("text").cast("string").alias("text"))
    return in_batches(rows, run, "doc_id long, hash long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode``, reduced to digests before rows leave Python."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of_file(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for value in batch.column("text"):
                ids = bpe.encode(value.as_py() or "")
                n.append(len(ids) // 4)
                of_ids.append(sha(ids))
                of_text.append(sha(bpe.decode(ids).encode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
