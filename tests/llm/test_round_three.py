"""Alignment, hard negatives and merge replay against brute force and the libraries, and on edge rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from cellwarden.llm import hard_negatives as hard
from cellwarden.llm import merge_replay as replay
from cellwarden.llm import token_alignment as alignment
from tests.llm.test_operators import EDGE, SF

tokens = pytest.importorskip("public_tokenizers")
A, B = tokens.path("byte_bpe_50k.json"), tokens.path("piece_bpe_32k.model")
RANKS = tokens.path("byte_bpe_multi_50k.tiktoken")

ODD = [" ", "  ", "a ", "  a  b ", "a▁b c", "<|endoftext|> </s> <unk> <0x41> x", "日本語 🎉\t\r\n x;\r\n", "　a　 b", "\x1c x \x1c", "x" * 5000 + " y",
       "aaaaaaaaaaaaaaaaaaaaaaa " * 3, "ﬁ Å é é"]


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return found + [(i, t[:20000] if t else t) for i, t in EDGE] + [(1000 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, row int, pair string, word string")


def key(row):
    return tuple((x is None, x) for x in row)


# 11 alignment

def plain_alignment(rows):
    v = alignment.Vocabularies(A, B)
    found = []
    for i, text in rows:
        a = v.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = v.b.encode(text) if text else []
        of_a, of_b = [v.bytes_a[t] for t in a], [v.bytes_b[t] for t in b]
        if not text or not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            found.append((i, 0, 0, [], [], ""))
            continue
        end_a = dict(zip(itertools.accumulate(map(len, of_a)), range(len(a))))
        end_b = dict(zip(itertools.accumulate(map(len, of_b)), range(len(b))))
        groups, links, p, q = [], [], 0, 0
        for end in sorted(end_a.keys() & end_b.keys()):
            i_a, i_b = end_a[end], end_b[end]
            groups.append(",".join(map(str, a[p:i_a + 1])) + "|" + ",".join(map(str, b[q:i_b + 1])))
            links.append((a[i_a], b[i_b]))
            p, q = i_a + 1, i_b + 1
        found.append((i, len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(link for f in found for link in f[4])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((i, n_a, n_b, len(g), len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), sha)
                   for i, n_a, n_b, g, ls, sha in found), key=key)


@pytest.mark.parametrize("frequent", [1 << 17, 30])
def test_alignment(spark, rows, docs, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)  # 30: most pairs go through the join
    got = alignment.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == plain_alignment(rows)
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_alignment_groups(spark):
    got = alignment.alignments(spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string"), A, B, with_groups=True).first()
    assert hashlib.sha256(got["groups"].encode()).hexdigest() == got["groups_sha256"]
    assert got["groups"].count(";") + 1 == got["n_groups"] == got["n_links"]


# 12 hard negatives

def test_hilbert_curve_takes_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = hard.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def plain_negatives(rows):
    kept = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if sum(x * x for x in q) < 2**56:
            kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a in kept:
        if a[0] % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), *b) for b in kept if b != a and len(a[2]) == len(b[2]))
            for p in [s for s in scored if s[2] == a[1]][:5]:
                below = [s for s in scored if s[2] != a[1] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
                out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(below)]
    return sorted(out)


@pytest.mark.parametrize("block, chunk, page, send", [(512 << 10, 1024, 256, 64 << 20), (64 * 24, 16, 2, 4096)])
def test_hard_negatives(spark, monkeypatch, block, chunk, page, send):
    monkeypatch.setattr(hard, "BROADCAST_BYTES", send)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i if rng.random() < 0.8 else 100 * (i % 30), rng.choice([0, 1, 2, None]), [x + rng.gauss(0, 0.05) for x in rng.choice(centres)])
            for i in range(700)]
    c = centres[0]
    rows += [(100, 1, c)] * 200 + [(200 + i, 1, c) for i in range(150)]  # repeated rows and ties
    rows += [(None, 1, c), (300, 1, None), (300, 1, [1.0, None]), (300, 2, [math.nan] * 6), (300, 2, [math.inf] * 6), (400, 1, []), (401, 2, []),
             (402, 1, []), (500, 1, [1.0, 2.0]), (501, 1, [1.0, 1.5]), (502, 2, [0.5, 1.0]), (600, 1, [9e5, 1e5]), (601, 1, [3e5, 1e5]),
             (602, 2, [2e5, 1e5]), (700, 1, [3e30, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, key string, dim int")
    got = hard.hard_negatives(df, block, chunk, page)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert hard.hard_negatives(df.limit(0)).collect() == []


def test_bounds_exclude_far_blocks(spark):
    """On clustered vectors most blocks are never joined to an anchor."""
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(0, 1, (20, 6)) * 4, 100, axis=0) + rng.normal(0, 0.01, (2000, 6))
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<float>")
    folder = hard.index(df, 64 * 24)
    anchors = hard._kind(spark, folder, "anchors").withColumnRenamed("block", "chunk")
    zones = hard._kind(spark, folder, "zones").selectExpr("dim", "ids zone_ids", "lo zone_lo", "hi zone_hi")
    chosen = zones.join(anchors, "dim").mapInArrow(hard._choose(False), "block long, chunk long, need binary").collect()
    blocks = hard._kind(spark, folder, "block").count()
    assert blocks > 20
    assert sum(len(r["need"]) // 4 for r in chosen) < 0.3 * 20 * blocks


# 13 merge replay

def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=replay.Ranks(RANKS).rank, special_tokens={})


def test_replay_equals_the_library(rows, monkeypatch):
    monkeypatch.setattr(replay, "KEPT", 300)
    monkeypatch.setattr(replay, "REPLAY_BYTES", 700)
    rng, ranks, own = random.Random(1), replay.Ranks(RANKS), library()
    vocabulary = list(ranks.rank)
    texts = [t or "" for _, t in rows] + ["ab" * 3000 + "ba" * 500, "日本語" * 500]
    texts += [b"".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 8))).decode("utf-8", "replace") for _ in range(3000)]
    texts += ["".join(rng.choice(" \n\ta'sé1!\x1c　") for _ in range(30)) for _ in range(500)]
    encoder = replay.Encoder(ranks, tokens.PATTERN, [(b" the", np.array(own.encode_ordinary(" the"), "<u4").tobytes())])
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        for text, found in zip(part, encoder.entries(part), strict=True):
            ids = [int(i) for e in found if e[0] for i in e[1].split(",")]
            assert ids == own.encode_ordinary(text)
            assert b"".join(e[2] for e in found).decode() == text and sum(e[0] for e in found) == len(ids)


def test_lower_ranks_come_first():
    """A merge may make a pair of lower rank: it goes before the word's other positions."""
    ranks = replay.Ranks(RANKS)
    size = ranks.size
    lower = [(a, b, r) for a, b, r in ((k // size, k % size, r) for k, r in ranks.made.items()) if r < max(a, b)]
    assert len(lower) > 1000
    own = library()
    words = [(ranks.bytes_of[a] + ranks.bytes_of[b]) * n for a, b, _ in lower[:1500] for n in (2, 3)]
    words = [w for w in words if w.decode("utf-8", "ignore").encode() == w]
    for w, ids in zip(words, ranks.replay(words), strict=True):
        assert ids == own._encode_single_piece(w)


def test_replay_query(spark, rows, docs):
    own = library()
    want = []
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, replay.digests(docs, RANKS, tokens.PATTERN).collect()), key=key) == sorted(want, key=key)
    assert replay.digests(docs.limit(0), RANKS, tokens.PATTERN).collect() == []
    got = {(r["doc_id"], r["hash"]): r for r in replay.encode(docs, RANKS, tokens.PATTERN).collect()}
    texts = {t or "" for _, t in rows}
    assert all(bytes(r["decoded"]).decode() in texts and len(r["ids"]) == 4 * r["n_tokens"] for r in got.values())


def test_lexicon_holds_the_frequent_words(spark, docs, monkeypatch):
    monkeypatch.setattr(replay, "LEXICON", 50)
    words = {bytes(r["word"]): np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in replay.lexicon(docs, RANKS, tokens.PATTERN).collect()}
    own = library()
    assert 0 < len(words) <= 100 and all(own.decode_bytes(ids) == w for w, ids in words.items())
