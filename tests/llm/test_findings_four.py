"""Findings of round 4: tables that grow with the input are joined by shuffles, not sent out whole by their estimated size."""

import random

import pytest

from cellwarden.llm import components, neardup

LIMIT = "spark.sql.maxBroadcastTableSize"


@pytest.fixture
def little(spark):
    """A session in which a broadcast table may have 64 KB: far less than what 300 documents unfold to."""
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "64k")
    yield spark
    spark.conf.set(LIMIT, before)


def _rows(n=300):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for i in range(n)]
    near = [(n + i, text + " end") for i, text in rows[:40]]
    twice = [(2 * n + i, text) for i, text in rows[20:60]]
    return [*rows, *near, *twice, (None, rows[0][1]), (3 * n, ""), (3 * n + 1, None)]


def test_unfolded_keys_are_not_broadcast(little):
    docs = little.createDataFrame(_rows(), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert all(got[i] == i for i in range(300))
    assert all(got[300 + i] == i for i in range(40)) and all(got[600 + i] == i for i in range(20, 60))
    assert got[None] == 0 and got[900] == 900 and got[901] == 901 and len(got) == 383


def test_edges_are_not_broadcast(little):
    n = 20_000
    edges = little.range(n).selectExpr("id - id % 10 as u", "id as v")
    found = components.components(edges)
    assert found.count() == n and found.filter("component <> node - node % 10").isEmpty()


def test_chosen_documents_are_not_broadcast(little, monkeypatch):
    import corpus_pipeline as P

    rows = [(i, f"text {i}") for i in range(20_000)]
    docs = little.createDataFrame(rows, "doc_id long, text string").repartition(2)
    alone = docs.selectExpr("doc_id", "xxhash64(text) as hash", "doc_id as component", "true as kept")
    monkeypatch.setattr(neardup, "grouped", lambda _: alone)
    assert P.near_copies(little, docs, "").count() == len(rows)
