"""Findings of round 3, third pass: a group whose members share buckets but mostly stay apart."""

import random

from cellwarden.llm import neardup


def _groups(rows):
    sets = {i: set(neardup.shingle_set(t, neardup.WordHashes()).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_members_that_link_with_nobody_do_not_meet_all_others(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(120), 4):  # two such texts have a similarity of about a half
            words[at] = f"v{i}x{at}"
        if i % 60 == 0:  # a few links between members that are not central
            rows.append((1000 + i, " ".join([*words, "end"])))
        rows.append((i, " ".join(words)))
    compared = []
    in_batches = neardup.in_batches

    def spy(df, run, schema):
        if {"block_a", "text_a"} & set(df.columns):
            compared.append(df.count())
        return in_batches(df, run, schema)

    monkeypatch.setattr(neardup, "in_batches", spy)
    monkeypatch.setattr(neardup, "BLOCK", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == _groups(rows)
    assert len(set(got.values())) > 200
    assert sum(compared[1:]) <= 3 * len(rows), compared  # after the leads of their keys; all blocks: 300 * 300 / 10


def test_every_similar_pair_is_among_the_rest(spark):
    """Pairs by places of the first common shingle: none that is similar is left out, whatever the sizes."""
    rng = random.Random(12)
    rows = []
    for i in range(90):
        words = [f"g{i % 5}w{k}" for k in range(rng.choice((3, 20, 60, 75)))]
        for at in rng.sample(range(len(words)), min(len(words) - 1, rng.randrange(4))):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    texts = spark.createDataFrame(rows, "cid long, text string")
    labels = texts.selectExpr("cid node", "cid component")
    prefixes = neardup._prefixes(texts, neardup.WIDTH, neardup.SHARE)
    pairs = {(r["a"], r["b"]) for r in neardup._rest_pairs(*neardup._bucketed(prefixes, labels), neardup.SHARE).collect()}
    sets = [set(neardup.shingle_set(t, neardup.WordHashes()).tolist()) for _, t in rows]
    similar = {(j, i) for i in range(90) for j in range(i)
               if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert similar and similar <= pairs and len(pairs) < 90 * 89 / 4
