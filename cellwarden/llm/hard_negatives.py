"""Hard negatives: Hilbert-ordered blocks of vectors with zone maps, read only where interval bounds allow.

Components become integers, floor(256 x), so every score is an exact integer.
Rows are sorted along a Hilbert curve over the ``CURVE_DIMS`` dimensions of
largest variance, and by id, so that equal vectors spread over blocks. Each
block is one Parquet row of about ``BLOCK_BYTES``; beside it lies its zone map,
the least and greatest value of every dimension. For an anchor and a box the
scores lie between

    sum(min(a lo, a hi))  and  sum(max(a lo, a hi)),

which tells from the zone maps alone whether a block can hold a positive (a
score as high as the fifth found in the anchor's own block) or a negative (a
score inside a window of one of its positives). Only such blocks are joined to
the anchors that need them, a chunk of anchors at a time, and a task keeps the
best few per anchor and window. Bounds carry a margin for rounding, so no
block is missed. On vectors without any structure the bounds exclude little
and the anchors are scored against all rows, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwarden.llm.common import BROADCAST_BYTES, in_batches, shared_folder, stored

EVERY = 100  # ids divisible by it are anchors
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
CURVE_DIMS, CURVE_BITS = 8, 7
BLOCK_BYTES = 512 << 10
CHUNK = 1024  # anchors handled together
PAGE = 256  # zone maps handled together
PART_BYTES = 32 << 20  # vectors sorted in one task
MOST_NORM = 2.0**28  # below it, 100 times any score is a long

_NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, q (integers) of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
            .select("vec_id", label.alias("label"), q.alias("q"))
            .filter(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x) < MOST_NORM**2)
            .select("vec_id", "label", F.size("q").alias("dim"), F.transform("q", lambda x: x.try_cast("int")).alias("q")))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of the rows of ``cells`` (coordinates below 2**bits)."""
    x = np.array(cells.T, np.int64)
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations and reflections, from the top bit down
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(x[i] & q, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> bit & 1
    return key


def _vectors(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int32).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int32)


def along_curve(rows: DataFrame) -> tuple[DataFrame, int]:
    """``quantised`` rows with their place ``key`` on the curve, and the bytes of all vectors."""
    spread = (rows.select("dim", F.posexplode("q").alias("at", "x")).groupBy("dim", "at")
              .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("var"), F.count("*").alias("n")))
    of_dim: dict[int, list] = {}
    size = 0
    for r in spread.collect():  # one row for each dimension
        of_dim.setdefault(r["dim"], []).append((-r["var"], r["at"], r["lo"], r["hi"]))
        size += 4 * r["n"]
    chosen = {d: sorted(v)[:CURVE_DIMS] for d, v in of_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            keys = np.zeros(len(dims), np.int64)
            for d in set(dims.tolist()) - {0}:
                here = np.flatnonzero(dims == d)
                v = _vectors(batch.column("q").take(pa.array(here)), d)
                lo = np.array([c[2] for c in chosen[d]], float)
                wide = np.maximum(np.array([c[3] for c in chosen[d]], float) - lo, 1)
                cells = (v[:, [c[1] for c in chosen[d]]] - lo) / wide * ((1 << CURVE_BITS) - 1)
                keys[here] = hilbert(cells.astype(np.int64), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "key"])

    return in_batches(rows, run, "vec_id long, label long, dim int, q array<int>, key long"), size


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact scores of all rows of a and b; no partial sum exceeds the product of the norms."""
    norm = lambda m: float(np.sqrt((m.astype(float)**2).sum(axis=1).max(initial=0)))
    most = norm(a) * norm(b) * 1.001
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _blocks(block_bytes: int, most_anchors: int, most_zones: int):
    """Sorted rows to rows of three kinds: blocks with all vectors, pages of zone maps, chunks of anchors."""
    return lambda batches: _build(batches, block_bytes, most_anchors, most_zones)


def _build(batches: Iterator[pa.RecordBatch], block_bytes: int, most_anchors: int, most_zones: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 23
    number = 0
    zones, anchors = [], []

    def row(kind, dim, block, **binary):
        names = ("ids", "labels", "vectors", "uids", "floors", "lo", "hi")
        return {"kind": kind, "dim": dim, "block": block} | {
            n: np.ascontiguousarray(binary[n]).tobytes() if n in binary else None for n in names}

    def page(dim):
        if zones:
            yield row("zones", dim, 0, ids=[z[0] for z in zones], lo=np.stack([z[1] for z in zones]), hi=np.stack([z[2] for z in zones]))
            zones.clear()

    def chunk(dim):
        if anchors:
            made = {n: np.concatenate([a[n] for a in anchors]) for n in anchors[0]}
            anchors.clear()
            for at in range(0, len(made["ids"]), most_anchors):
                piece = {n: v[at:at + most_anchors] for n, v in made.items()}
                yield row("anchors", dim, int(piece["uids"][0]), **piece)

    def block(dim, ids, labels, v):
        nonlocal number
        name, number = part | number, number + 1
        uids = (name << 20) + np.arange(len(ids))
        yield row("block", dim, name, ids=ids, labels=labels, vectors=v, uids=uids)
        zones.append((np.int64(name), v.min(axis=0), v.max(axis=0)))
        at = np.flatnonzero(ids % EVERY == 0)
        if len(at):
            floors = np.full(len(at), _NONE)
            for k in range(0, len(at), most_anchors):
                own = at[k:k + most_anchors]
                scores = _dot(v[own], v).astype(np.int64)
                scores[labels[own][:, None] != labels] = _NONE
                scores[np.arange(len(own)), own] = _NONE
                if len(ids) > POSITIVES:
                    floors[k:k + most_anchors] = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES]
            anchors.append({"ids": ids[at], "labels": labels[at], "vectors": v[at], "uids": uids[at], "floors": floors})
            if sum(len(a["ids"]) for a in anchors) >= most_anchors:
                yield from chunk(dim)
        if len(zones) >= most_zones:
            yield from page(dim)

    def rows():
        dim, held, last = None, [], None
        for batch in batches:
            dims, ids, labels = (np.asarray(batch.column(c)) for c in ("dim", "vec_id", "label"))
            bounds = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if dims[a] != dim:
                    if held:
                        yield from block(dim, *map(np.concatenate, zip(*held)))
                    yield from page(dim)
                    yield from chunk(dim)
                    dim, held, last = int(dims[a]), [], None
                v = _vectors(batch.column("q").slice(a, b - a), dim)
                i, lab = ids[a:b], labels[a:b]
                fresh = np.ones(b - a, bool)  # a repeated row equals the one before it
                fresh[1:] = (i[1:] != i[:-1]) | (lab[1:] != lab[:-1]) | (v[1:] != v[:-1]).any(axis=1)
                fresh[0] = last is None or last[0] != i[0] or last[1] != lab[0] or bool((last[2] != v[0]).any())
                last = (i[-1], lab[-1], v[-1])
                held.append((i[fresh], lab[fresh], v[fresh]))
                most = max(64, block_bytes // (4 * max(dim, 1)))
                while sum(len(h[0]) for h in held) >= most:
                    whole = list(map(np.concatenate, zip(*held)))
                    yield from block(dim, *(w[:most] for w in whole))
                    held = [tuple(w[most:] for w in whole)]
        if held and sum(len(h[0]) for h in held):
            yield from block(dim, *map(np.concatenate, zip(*held)))
        yield from page(dim)
        yield from chunk(dim)

    for r in rows():
        yield pa.RecordBatch.from_pylist([r], schema=_KINDS)


_BINARY = ("ids", "labels", "vectors", "uids", "floors", "lo", "hi")
_KINDS = pa.schema([("kind", pa.string()), ("dim", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in _BINARY)])
_KINDS_DDL = "kind string, dim int, block long, " + ", ".join(f"{n} binary" for n in _BINARY)


def index(rows: DataFrame, block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK, page: int = PAGE) -> str:
    """Writes blocks, zone maps and anchors of (vec_id, label, embedding); the folder they are in."""
    spark = rows.sparkSession
    placed, size = along_curve(quantised(rows))
    parts = max(1, -(-size // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // block_bytes)))
    order = ["dim", "key", "vec_id"]
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "label", "q")
    folder = shared_folder(spark, "blocks")
    in_batches(placed, _blocks(block_bytes, chunk, page), _KINDS_DDL).write.partitionBy("kind").parquet(folder)
    return folder


def _kind(spark, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(_KINDS_DDL).parquet(folder).filter(F.col("kind") == kind).drop("kind")


def _of(value, kind, dim: int | None = None) -> np.ndarray:
    found = np.frombuffer(value.as_py(), kind)
    return found if dim is None else found.reshape(-1, dim) if dim else np.zeros((0, 0), kind)


def _windows(batch: pa.RecordBatch, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each window of a chunk's ``n`` anchors; an absent window is empty."""
    low, high = np.full(n * POSITIVES, 1), np.full(n * POSITIVES, 0)
    slots, scores = (np.array(batch.column(c)[k].as_py(), np.int64) for c in ("slots", "scores"))
    low[slots], high[slots] = -(-LOW * scores // 100), HIGH * scores // 100
    return low.reshape(n, POSITIVES), high.reshape(n, POSITIVES)


def _choose(windows: bool):
    """For pages of zone maps beside chunks of anchors: (block, chunk, which anchors) that must meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, chunks, needs = [], [], []
            for k in range(batch.num_rows):
                dim = batch.column("dim")[k].as_py()
                ids = _of(batch.column("zone_ids")[k], np.int64)
                names = _of(batch.column("uids")[k], np.int64)
                a, lo, hi = (_of(batch.column(c)[k], np.int32, dim).astype(float) for c in ("vectors", "zone_lo", "zone_hi"))
                if dim:
                    up, down = np.maximum(a, 0), np.minimum(a, 0)
                    most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                else:
                    most = least = np.zeros((len(names), len(ids)))
                most, least = most + 1 + 1e-9 * np.abs(most), least - 1 - 1e-9 * np.abs(least)
                if windows:
                    low, high = _windows(batch, k, len(names))
                    need = np.zeros(most.shape, bool)
                    for j in range(POSITIVES):
                        need |= (low[:, j] <= high[:, j])[:, None] & (most >= low[:, j, None]) & (least <= high[:, j, None])
                else:
                    need = most >= _of(batch.column("floors")[k], np.int64)[:, None]
                for b in np.flatnonzero(need.any(axis=0)):
                    blocks.append(int(ids[b]))
                    chunks.append(batch.column("chunk")[k].as_py())
                    needs.append(np.flatnonzero(need[:, b]).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(chunks, pa.int64()), pa.array(needs, pa.binary())],
                                             names=["block", "chunk", "need"])
    return run


class Best:
    """The best ``k`` of every slot of a chunk: highest score, then least id."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.rows = np.zeros((4, 0), np.int64)  # slot, score, id, uid

    def add(self, slot, score, ids, uids) -> None:
        rows = np.concatenate([self.rows, np.stack([slot, score, ids, uids]).astype(np.int64)], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - first
        full = rows[:, place == self.k - 1]
        self.floor[full[0]] = np.maximum(self.floor[full[0]], full[1])
        self.rows = rows[:, place < self.k]


def _score(windows: bool):
    """Best rows of the chosen blocks for every anchor (``windows``: for each of its windows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[Best, np.ndarray]] = {}

        def rows(chunk):
            found, names = best.pop(chunk)
            slot, score, ids, uids = found.rows
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(slot), pa.int64()), pa.array(names[slot // (POSITIVES if windows else 1)]),
                 pa.array(slot), pa.array(score), pa.array(ids), pa.array(uids)],
                names=["chunk", "anchor_id", "slot", "score", "id", "uid"])

        for batch in batches:
            for k in range(batch.num_rows):
                dim, chunk = batch.column("dim")[k].as_py(), batch.column("chunk")[k].as_py()
                need = _of(batch.column("need")[k], np.uint32).astype(np.int64)
                names, own, of = (_of(batch.column(c)[k], np.int64) for c in ("anchor_ids", "anchor_uids", "anchor_labels"))
                ids, uids, labels = (_of(batch.column(c)[k], np.int64) for c in ("ids", "uids", "labels"))
                if dim:
                    scores = _dot(_of(batch.column("anchor_vectors")[k], np.int32, dim)[need], _of(batch.column("vectors")[k], np.int32, dim))
                else:
                    scores = np.zeros((len(need), len(ids)), np.int64)
                same = of[need][:, None] == labels
                if windows:
                    low, high = _windows(batch, k, len(names))
                    if chunk not in best:
                        best[chunk] = Best(len(names) * POSITIVES, NEGATIVES, low.ravel()), names
                    found = best[chunk][0]
                    for j in range(POSITIVES):
                        floor = found.floor[need * POSITIVES + j].astype(scores.dtype)
                        top = np.where(low[need, j] <= high[need, j], high[need, j], _NONE).astype(scores.dtype)
                        at, to = np.nonzero((scores >= floor[:, None]) & (scores <= top[:, None]) & ~same)
                        if len(at):
                            found.add(need[at] * POSITIVES + j, scores[at, to], ids[to], uids[to])
                else:
                    if chunk not in best:
                        best[chunk] = Best(len(names), POSITIVES, _of(batch.column("floors")[k], np.int64)), names
                    found = best[chunk][0]
                    floor = found.floor[need].astype(scores.dtype)
                    at, to = np.nonzero((scores >= floor[:, None]) & same & (own[need][:, None] != uids))
                    if len(at):
                        found.add(need[at], scores[at, to], ids[to], uids[to])
                if len(best) > 64:
                    yield rows(next(iter(best)))
        for chunk in list(best):
            yield rows(chunk)
    return run


_FOUND = "chunk long, anchor_id long, slot long, score long, id long, uid long"


def _meet(folder: str, anchors: DataFrame, size: int, windows: bool, k: int) -> DataFrame:
    """The best ``k`` rows of every slot, with their rank, over the blocks that the bounds choose."""
    spark = anchors.sparkSession
    send = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    buckets = max(1, -(-size // (BROADCAST_BYTES // 2)))
    extra = ["slots", "scores"] if windows else ["floors"]
    pages = _kind(spark, folder, "zones").select(
        "dim", F.col("ids").alias("zone_ids"), F.col("lo").alias("zone_lo"), F.col("hi").alias("zone_hi"),
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    asking = anchors.withColumn("bucket", F.pmod(F.xxhash64("chunk"), F.lit(buckets)).cast("int"))
    both = pages.join(send(asking.select("dim", "bucket", "chunk", "uids", "vectors", *extra)), ["dim", "bucket"])
    chosen = stored(in_batches(both, _choose(windows), "block long, chunk long, need binary"), "chosen")
    blocks = _kind(spark, folder, "block").select("dim", "block", "ids", "labels", "vectors", "uids")
    of = anchors.select("chunk", F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"),
                        F.col("vectors").alias("anchor_vectors"), F.col("uids").alias("anchor_uids"), *extra)
    found = in_batches(blocks.join(chosen, "block").join(send(of), "chunk"), _score(windows), _FOUND)
    place = Window.partitionBy("chunk", "slot").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK, page: int = PAGE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (vec_id, label, embedding).

    Anchors are rows whose id is divisible by ``EVERY``, positives an anchor's
    best other rows of its label, negatives the best rows of other labels
    scoring ``LOW`` to ``HIGH`` percent of the positive; ties go to the smaller id.

    * A null label, vector or component or one that is not finite takes a row
      out; so do a null id, by which nothing could be named, and a norm of
      2**28 or more after scaling by 256, whose scores no long could hold.
    * Repeated rows count once. Rows that share an id but differ are rows of
      their own; ties between them go by label, then vector.
    * Vectors are compared with those of their own length; empty ones score 0.
    * Fewer rows than asked for are all returned; an anchor without positives
      or negatives has no row. Extra columns are ignored, and an empty table
      gives an empty result.
    """
    spark = rows.sparkSession
    folder = index(rows, block_bytes, chunk, page)
    anchors = _kind(spark, folder, "anchors").withColumnRenamed("block", "chunk").drop("lo", "hi")
    size = anchors.agg(F.sum(sum((F.octet_length(c) for c in _BINARY[:5]), F.lit(64)))).first()[0] or 0
    positives = stored(_meet(folder, anchors, size, False, POSITIVES).withColumn(
        "slot", F.col("slot") * POSITIVES + F.col("rank") - 1), "positives")
    slots = positives.groupBy("chunk").agg(F.collect_list(F.struct("slot", "score")).alias("s")).select(
        "chunk", F.col("s.slot").alias("slots"), F.col("s.score").alias("scores"))  # at most POSITIVES x CHUNK
    asking = stored(anchors.drop("floors").join(slots, "chunk"), "windows")
    negatives = _meet(folder, asking, 2 * size, True, NEGATIVES)
    of = positives.select("chunk", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["chunk", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
