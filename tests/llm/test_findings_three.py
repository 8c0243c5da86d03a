"""Findings of round 3, second pass: a group of near copies with some members that stay apart."""

import random

from cellwarden.llm import neardup


def test_a_group_of_near_copies_is_not_compared_block_by_block(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(120), 1 if i % 50 else 6):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    sets = {i: set(neardup.shingle_set(t, neardup.WordHashes()).tolist()) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    moved = []
    in_batches = neardup.in_batches

    def spy(df, run, schema):
        if "block_a" in df.columns:
            moved.append(df.count())
        return in_batches(df, run, schema)

    monkeypatch.setattr(neardup, "in_batches", spy)
    monkeypatch.setattr(neardup, "BLOCK", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in sets}
    assert sum(moved) <= 3 * len(rows), moved  # with all blocks against all: 300 * 300 / 10
