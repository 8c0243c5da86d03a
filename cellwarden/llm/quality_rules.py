"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule votes good (1), bad (-1) or abstains (0). How often each rule
votes what on good and on bad documents is estimated without labels from the
counts of vote patterns over the whole corpus; a document is kept if its
posterior probability of being good is at least one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import WordHashes, in_batches, stored, text_key, windows

REPEAT_WIDTH = 8
_SPACE = b" \t\n\r\x0b\x0c"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims",
           "n_alpha_words")


def text_counts(text: str | None, words: WordHashes) -> tuple[int, ...]:
    """The values of ``_COUNTS`` of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    without = lambda chars: len(data) - len(data.translate(None, chars))
    tokens = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if len(tokens) >= REPEAT_WIDTH:
        _, place, counts = np.unique(windows(words.of(tokens), REPEAT_WIDTH), return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[place] > 1)
        edges = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + REPEAT_WIDTH, -1)
        repeated = int((np.cumsum(edges[:-1]) > 0).sum())
    letters = sum(1 for t in tokens if t[:1].isalpha() or t[0] >= 0x80)
    return (len(tokens), len(text) - without(_SPACE), without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated,
            len(lines), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"!"), letters)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, hash and the counts of each row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            rows = [text_counts(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"),
                 *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_COUNTS))]],
                names=["doc_id", "hash", *_COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("hash"),
                       F.col("text").cast("string").alias("text"))
    return in_batches(rows, run, "doc_id long, hash long, " + ", ".join(f"{c} long" for c in _COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote as an expression on the counts."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    return {
        "length": _vote(c("n_words") >= 50, c("n_words") < 20),
        "word_length": _vote(c("word_chars").between(3 * n, 9 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 14 * n)),
        "symbols": _vote(20 * c("n_symbols") < n, 8 * c("n_symbols") > n),
        "lines": _vote(10 * c("n_dup_lines") < c("n_lines"), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": _vote(20 * c("n_repeat_words") < n, 100 * c("n_repeat_words") > 30 * n),
        "upper": _vote(20 * c("n_upper") < 3 * c("word_chars"), 10 * c("n_upper") > 3 * c("word_chars")),
        "exclaims": _vote(F.lit(False), 10 * c("n_exclaims") > n),
        "letters": _vote(10 * c("n_alpha_words") >= 9 * n, 10 * c("n_alpha_words") < 7 * n),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(log prior odds, log odds [rule, vote + 1]) by expectation-maximisation over vote patterns.

    Starts from the share of good votes; counts are smoothed, so that a vote
    never seen says little. No patterns give zeros.
    """
    k = votes.shape[1]
    if len(votes) == 0:
        return 0.0, np.zeros((k, 3))
    cast = (votes != 0).sum(axis=1)
    post = np.clip(0.5 + votes.sum(axis=1) / (2 * np.maximum(cast, 1)), 0.05, 0.95)
    for _ in range(rounds):
        good, bad = counts * post, counts * (1 - post)
        prior = np.log((good.sum() + 1) / (bad.sum() + 1))
        odds = np.zeros((k, 3))
        for v in (-1, 0, 1):
            is_v = votes == v
            odds[:, v + 1] = (np.log(((good[:, None] * is_v).sum(axis=0) + 1) / (good.sum() + 3))
                              - np.log(((bad[:, None] * is_v).sum(axis=0) + 1) / (bad.sum() + 3)))
        raw = prior + odds[np.arange(k), votes + 1].sum(axis=1)
        fresh = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        if np.abs(fresh - post).max() < 1e-9:
            break
        post = fresh
    return float(prior), odds


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, hash, the counts, base_failed, posterior and kept for each row of ``docs``.

    base_failed: under 20 words, or over 30 % of the words in repeated
    eight-word windows. kept: not base_failed and posterior >= 0.5.

    * A null or empty text has zero counts and fails.
    * Repeated rows are judged alike; null ids and extra columns change
      nothing; an empty table gives an empty result.
    """
    rows = stored(measured(docs), "counts")
    named = rules()
    voted = rows.select("*", *[v.alias(f"vote_{k}") for k, v in named.items()])
    # At most 3 ^ rules patterns, whatever the corpus.
    patterns = voted.groupBy(*[f"vote_{k}" for k in named]).agg(F.count("*").alias("n")).collect()
    votes = np.array([[r[f"vote_{k}"] for k in named] for r in patterns], int).reshape(len(patterns), len(named))
    prior, odds = estimate(votes, np.array([r["n"] for r in patterns], float))
    raw = F.lit(prior)
    for i, k in enumerate(named):
        vote = F.col(f"vote_{k}")
        raw = raw + F.when(vote < 0, float(odds[i, 0])).when(vote > 0, float(odds[i, 2])).otherwise(float(odds[i, 1]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-raw))
    return voted.select("doc_id", "hash", *_COUNTS[:5], failed.alias("base_failed"), posterior.alias("posterior"),
                        (~failed & (posterior >= 0.5)).alias("kept"))
