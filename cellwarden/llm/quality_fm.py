"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)):
all pairwise interactions in time linear in the number of features.

The model is fitted on a bounded sample of labelled rows (``MOST_ROWS``, those
with the least hash of their id); rows are scored where they lie. Labels,
lang, source and ids are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.llm.common import ASCII_LOWER, WordHashes, in_batches

MOST_ROWS = 8_000  # labelled rows the model is fitted on, at most
WORDS = 1 << 15  # hashed word features
RANK = 6

# Bin edges of the structure statistics, as fixed parameters.
_EDGES = {
    "chars_log2": (0.5, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16),
    "words_log2": (0.5, 2, 4, 5, 6, 7, 8, 9, 10, 11, 13),
    "word_length": (1.5, 3, 4, 5, 6, 7, 8, 10, 14, 20),
    "upper": (0.001, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75),
    "digits": (0.001, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5),
    "symbols": (0.0005, 0.002, 0.01, 0.03, 0.06, 0.12, 0.25),
    "marks": (0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5),
    "exclaims": (0.0005, 0.002, 0.01, 0.03, 0.06, 0.12),
    "beyond_ascii": (0.001, 0.01, 0.03, 0.1, 0.3, 0.6),
    "space": (0.02, 0.05, 0.1, 0.14, 0.18, 0.22, 0.3, 0.5),
    "distinct_words": (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "top_word": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75),
    "repeated_lines": (0.001, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75),
    "words_in_line_log2": (0.5, 1, 2, 3, 4, 5, 6, 8),
}
_BINS = 16
SIZE = WORDS + _BINS * len(_EDGES)

_CLASS = np.zeros(256, np.uint8)  # 0 other letter, 1 upper, 2 digit, 3 symbol, 4 mark, 5 exclamation, 6 beyond ASCII, 7 space
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[*b"#*$%&|<>"]] = 3
_CLASS[[*b".,;:?'\"()[]{}/\\-_+=~^@`"]] = 4
_CLASS[ord("!")] = 5
_CLASS[0x80:] = 6
_CLASS[[*b" \t\n\r\x0b\x0c"]] = 7


def features(text: str | None, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text's features."""
    data = (text or "").encode("utf-8", "surrogatepass")
    classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) / max(len(data), 1)
    tokens = data.translate(ASCII_LOWER).split()
    ids, counts = np.unique(words.of(tokens) % np.uint64(WORDS), return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(tokens)
    stats = (
        np.log2(1 + len(text or "")), np.log2(1 + n), (sum(map(len, tokens)) / n) if n else 0.0,
        classes[1], classes[2], classes[3], classes[4], classes[5], classes[6], classes[7],
        len(ids) / n if n else 0.0, counts.max() / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, np.log2(1 + n / len(lines)) if lines else 0.0)
    bins = [WORDS + _BINS * i + int(np.searchsorted(e, v, side="right"))
            for i, (e, v) in enumerate(zip(_EDGES.values(), stats, strict=True))]
    tf = 1 + np.log(counts)
    tf /= np.sqrt((tf * tf).sum()) or 1.0
    return (np.concatenate([ids.astype(np.int32), np.array(bins, np.int32)]),
            np.concatenate([tf, np.full(len(bins), 0.3)]).astype(np.float32))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray) -> float:
        part = self.factors[ids] * values[:, None]
        total = part.sum(axis=0)
        return float(self.bias + self.linear[ids] @ values + 0.5 * ((total * total).sum() - (part * part).sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128,
          rate: float = 0.02, decay: float = 2e-4) -> Machine:
    """A machine fitted by Adam on mini-batches; without both labels, one that returns their share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(7)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    if len(labels) == 0 or labels.min() == labels.max():
        m.factors[:] = 0
        return m
    slots = [np.zeros(SIZE), np.zeros(SIZE), np.zeros((SIZE, RANK)), np.zeros((SIZE, RANK)), 0.0, 0.0]
    for epoch in range(epochs):
        step_rate = rate / (1 + 0.3 * epoch)
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at:at + batch]
            sizes = np.array([len(rows[i][0]) for i in pick])
            ids = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of_row = np.repeat(np.arange(len(pick)), sizes)
            part = m.factors[ids] * x[:, None]
            total = np.add.reduceat(part, first)
            raw = m.bias + np.add.reduceat(m.linear[ids] * x, first) + 0.5 * (
                (total ** 2).sum(axis=1) - np.add.reduceat((part ** 2).sum(axis=1), first))
            err = (_sigmoid(raw) - labels[pick]) / len(pick)
            used, place = np.unique(ids, return_inverse=True)
            g_linear = np.bincount(place, err[of_row] * x, len(used)) + decay * m.linear[used]
            g_part = err[of_row][:, None] * (x[:, None] * (total[of_row] - part))
            g_factors = np.stack([np.bincount(place, g_part[:, f], len(used)) for f in range(RANK)], 1) + decay * m.factors[used]
            for slot, param, g in ((0, m.linear, g_linear), (2, m.factors, g_factors)):
                slots[slot][used] = 0.9 * slots[slot][used] + 0.1 * g
                slots[slot + 1][used] = 0.99 * slots[slot + 1][used] + 0.01 * g * g
                param[used] -= step_rate * slots[slot][used] / (np.sqrt(slots[slot + 1][used]) + 1e-6)
            g = float(err.sum())
            slots[4], slots[5] = 0.9 * slots[4] + 0.1 * g, 0.99 * slots[5] + 0.01 * g * g
            m.bias -= step_rate * slots[4] / (slots[5] ** 0.5 + 1e-6)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id has no remainder and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Machine:
    """The machine fitted on at most ``most`` labelled rows of ``docs`` that are not held out.

    Labels of a repeated id count as 1 if any says so; null ids and labels are
    left out. Features are computed on the executors.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Broadcast: at most ``most`` pairs of numbers.
    rows = texts.join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            each = [features(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([i for i, _ in each], pa.list_(pa.int32())),
                 pa.array([v for _, v in each], pa.list_(pa.float32()))], names=["doc_id", "quality", "ids", "xs"])

    got = in_batches(rows, run, "doc_id long, quality int, ids array<int>, xs array<float>")
    # An id repeated in the documents is learnt from once.
    got = got.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id").combine_chunks()
    if got.num_rows == 0:
        return train([], np.zeros(0))
    # Views into the Arrow buffers, no Python object per feature.
    ids, xs = got.column("ids").chunk(0), got.column("xs").chunk(0)
    ends = ids.offsets.to_numpy()
    flat_ids, flat_xs = ids.values.to_numpy(), xs.values.to_numpy()
    pairs = [(flat_ids[a:b], flat_xs[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return train(pairs, got.column("quality").to_numpy().astype(np.float64))


def scored(docs: DataFrame, machine: Machine, column: str = "k_score") -> DataFrame:
    """``docs``, all columns, with the score of each row's whole text."""
    linear, factors = machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    bias, at = machine.bias, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = WordHashes(), Machine(bias, linear, factors)
        for batch in batches:
            scores = [float(_sigmoid(m.raw(*features(t.as_py(), words)))) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, column])

    return in_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    * A null or empty text is scored by its structure alone.
    * Rows are scored one by one, so repeated rows score alike; null ids,
      extra columns and an empty table need nothing special.
    * Without usable labels every score is 0.5 and every row is kept.
    """
    machine = fit(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, machine, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
