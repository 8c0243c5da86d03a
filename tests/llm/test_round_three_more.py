"""Proximity matches, range reads of archives, and input columns named like helpers."""

from __future__ import annotations

import random
import re

import pytest
from cellwarden.llm import decontaminate, secret_scan, warc
from tests.llm.test_operators import EDGE, SF, edge  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_near(doc: str, items):
    w, found = WORD.findall(doc.lower()), set()
    for item, text in items:
        v = WORD.findall((text or "").lower())
        most = len(v) + max(1, len(v) // 5)
        if v and item is not None and any(set(v) <= set(w[at:at + most]) for at in range(len(w))):
            found.add(str(item))
    return sorted(found)


def test_near_items_by_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)] + ["the"] * 9
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((1, 2, 3, 5, 8, 12, 20, 30, 0))] + [(9, None), (None, "w1 w2"), (10, "the the the the"), (3, "w3 w4 w5")]
    docs = [(0, None), (1, ""), (2, "--")]
    for i in range(3, 80):
        x = (items[rng.randrange(9)][1] or "").split()
        for _ in range(rng.randrange(4)):
            x.insert(rng.randrange(len(x) + 1), rng.choice(["new", "the", "w1"]))
        if rng.random() < 0.3:
            rng.shuffle(x)
        docs.append((i, f"{say(rng.randrange(9))}, {' - '.join(x).upper()}. {say(rng.randrange(9))}"))
    docs.append(docs[-1])
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.searched(df, tests).collect()
    assert len(got) == len(docs)
    of, exact = dict(docs), {(r["doc_id"], tuple(r["items"])) for r in decontaminate.decontaminate(df, tests).collect()}
    assert {(r["doc_id"], tuple(r["items"])) for r in got} == exact
    for r in got:
        assert list(r["near_items"]) == brute_near(of[r["doc_id"]] or "", items), (r, of[r["doc_id"]])
    assert any(set(r["near_items"]) - set(r["items"]) for r in got)


def test_near_items_of_edge_rows(spark, edge):  # noqa: F811
    items = spark.createDataFrame([(1, "one two three"), (None, "with some words")], "item_id long, text string")
    assert len(decontaminate.searched(edge, items).collect()) == len(EDGE)
    assert decontaminate.searched(edge.limit(0), items).collect() == []
    assert all(r["near_items"] == [] for r in decontaminate.searched(edge, items.limit(0)).collect())


class Counted:
    """A file that notes how much of it is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.read += len(self.data[at:at + n])
        return self.data[at:at + n]


@pytest.mark.parametrize("head", [8, 100, 1 << 16])
def test_heads_are_walked_without_their_blocks(head, monkeypatch):
    monkeypatch.setattr(warc, "HEAD_BYTES", head)
    sizes = [0, 3, 500_000, 7, 1_000_000, 70]
    data, want = b"", []
    for i, n in enumerate(sizes):
        record = b"WARC/1.1\r\nWARC-Target-URI: " + b"u" * (i * 40) + b"\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n
        want.append((len(data), len(record)))
        data += record + b"\r\n\r\n"
    source = Counted(data)
    assert [(at, n) for _, at, n in warc._heads(source)] == want
    assert source.read < 12 * max(head, 500)


def test_one_range_of_a_large_archive(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 60\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"
    path = tmp_path / "a b%20.warc"
    with open(path, "wb") as f:
        f.truncate(3 << 30)  # more than an array of bytes can hold
        f.seek((3 << 30) - 5)
        f.write(record)
    places = spark.createDataFrame([(f"file:{path}", (3 << 30) - 5, len(record))] * 2, "path string, offset long, length long")
    got = warc.read_ranges(places).collect()
    assert [(r["record_type"], r["payload_bytes"], r["payload"]) for r in got] == [("revisit", 9, None)]


def test_columns_named_like_helpers(spark):
    import corpus_pipeline as P

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text + " password=abcdef123", 5, "a"), (2, text, 6, "b"), (2, text, 6, "b")]
    names = ["k_spans", "k_rows", "k_id", "k_hash", "K_SCORE"]
    df = spark.createDataFrame([(*r, *r[2:3] * len(names)) for r in rows],
                               "doc_id long, text string, n_chars long, lang string, " + ", ".join(f"{n} long" for n in names))
    got = secret_scan.redacted(df)
    assert got.columns == df.columns and sorted(r["k_spans"] for r in got.collect()) == [5, 6, 6]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns
    assert P.near_copies(spark, df, SF).count() == 1
