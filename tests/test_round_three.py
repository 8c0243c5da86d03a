"""Deletion neighbourhoods, late rows, dataset versions, repeated appends and proofs."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cellwarden.operators import ledger as L
from cellwarden.operators import relate as R
from cellwarden.operators.repair import auto_edits
from cellwarden.operators.stats import fit
from cellwarden.plans.analyze import analyze
from cellwarden.sources.catalog import Catalog
from cellwarden.streaming import late as LT


def common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(row[j], before[j + 1], before[j] + (x == y)))
    return row[-1]


def nearest(rows):
    """Row -> (first close repeated value, similarity), by comparing all values with all."""
    n, first = collections.Counter(v for _, v in rows), {}
    for i, v in sorted(rows):
        first.setdefault(v, i)
    repeated, out = sorted((first[v], v) for v in n if n[v] > 1), {}
    for v in (v for v in n if n[v] == 1):
        for _, r in repeated:
            ratio = 2 * common(v.lower(), r.lower()) / (len(v) + len(r)) if v or r else 1
            if 0.85 <= ratio < 1:
                out[first[v]] = (r, round(ratio, 4))
                break
    return out


def test_deletion_neighbourhood_equals_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abC1") for _ in range(rng.randrange(1, 19))) for _ in range(220)]
    rows = []
    for i in range(1500):
        w = rng.choice(base)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w = w[:k] + rng.choice(["", "a", "1", "B"]) + w[k + rng.randrange(2):]
        rows.append((i, w))
    df = spark.createDataFrame(rows, "row_id long, t string")
    stats = fit(df, ["t"])
    assert stats.columns["t"].n_distinct > 500
    got = {r["row_id"]: (r["expected_value"], r["score"]) for r in R.near_duplicates(df, stats).collect()}
    assert got == nearest(rows) and len(got) > 100


def test_leftovers(spark):
    rows = spark.createDataFrame([("abca", 0), ("abca", 1), ("aaaa", 2), ("ab", 2), ("abcdef", 4)], "t string, k int")
    got = [sorted(r[0]) for r in rows.select(R.leftovers(F.col("t"), F.col("k"))).collect()]
    assert got[:4] == [["abca"], ["aba", "abc", "aca", "bca"], ["aa"], [""]]
    assert len(got[4]) == 15


def test_numbers_are_not_repaired(spark):
    rng = random.Random(2)
    rows = [(i, str(rng.randrange(10000, 400000)), rng.choice(["Berlin", "Hamburg", "Dresden"])) for i in range(3000)]
    rows += [(3000, "130817", "Hamburgg"), (3001, "13081", "Berlinn"), (3002, "13081", "Dresden")]
    a = analyze(spark.createDataFrame(rows, "id long, units string, city string"), "id")
    near = a.evidence.where("detector = 'near_duplicate_detector'")
    assert near.where("column = 'units'").count() >= 1 and near.where("column = 'units' and repair_deterministic").isEmpty()
    edits = {(r["row_id"], r["column"]): r["new_value"] for r in auto_edits(a.decisions).collect()}
    assert edits == {(3000, "city"): "Hamburg", (3001, "city"): "Berlin"}


def _arrivals(spark, path):
    """Four batches; some rows a batch late, some repeated, one without a time."""
    rows = [(i, i * 60, i % 5) for i in range(400)]
    batches = [[r for r in rows if min(r[0] // 100 + (r[0] % 17 == 0), 3) == b] for b in range(4)]
    batches[3] += [r for r in rows if r[0] % 23 == 0] + [(400, None, 1)]
    for b in batches:
        df = spark.createDataFrame(b, "id long, s long, v long").select("id", F.timestamp_seconds("s").alias("ts"), "v")
        df.coalesce(1).write.mode("append").parquet(path)
    return batches, spark.readStream.schema("id long, ts timestamp, v long").option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_have_a_sink(spark, tmp_path):
    batches, stream = _arrivals(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    LT.run_distinct(stream, ["id"], "ts", "10 minutes", out, str(tmp_path / "cp")).awaitTermination()
    first, late, seen, latest = [], [], set(), None
    for b in batches:
        for i, s, _ in b:
            if s is None or (latest is not None and s < latest - 600):
                late.append(i)
            elif i not in seen:
                seen.add(i)
                first.append(i)
        latest = max(x for x in [latest, *(s for _, s, _ in b)] if x is not None)
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/rows").collect()) == sorted(first)
    assert sorted(r["id"] for r in LT.late_rows(spark, out).collect()) == sorted(late) and len(late) > 10
    assert set(first) | set(late) == set(range(401))


def test_late_rows_correct_closed_windows(spark, tmp_path):
    batches, stream = _arrivals(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    sums = {"n": F.lit(1).cast("long"), "total": F.col("v")}
    LT.run_window_log(stream, "ts", "1 hour", "10 minutes", sums, out, str(tmp_path / "cp")).awaitTermination()

    def want(upto):
        n = collections.Counter()
        for i, s, v in (r for b in batches[:upto + 1] for r in b):
            n[None if s is None else s // 3600] += v
        return n

    def got(version=None):
        rows = LT.windows_as_of(spark, out, ["n", "total"], version=version).withColumn("w", F.unix_timestamp("window_start"))
        return {None if r["w"] is None else r["w"] // 3600: r["total"] for r in rows.collect()}

    assert got() == want(3) and got(1) == want(1) and got(1) != got()
    fixed = LT.changes(spark, out, ["n"]).where("closed").collect()
    assert fixed and all(r["n"] > r["replaced_n"] > 0 for r in fixed)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    summary = spark.createDataFrame([("a", 1)], "dataset_id string, auto_count int")
    table = spark.range(10)
    assert catalog.register("a", summary, table, "2024-01-01 00:00:00", table=table) == 1
    broken = spark.range(1000, numPartitions=8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        catalog.register("a", summary, table, "2024-01-02 00:00:00", table=broken)
    assert catalog.reload("a").count() == 10 and catalog.decisions("a").count() == 10
    assert catalog.dataset("a").first()["version"] == 1
    snapshot = catalog.reload("a")
    catalog.register("a", summary.withColumn("auto_count", F.lit(2)), table, "2024-01-03 00:00:00", table=spark.range(20))
    assert snapshot.count() == 10 and catalog.reload("a").count() == 20 and catalog.reload("a", 1).count() == 10
    assert catalog.dataset("a").first()["auto_count"] == 2
    catalog.delete("a", "2024-01-04 00:00:00")
    assert catalog.datasets().isEmpty() and catalog.decisions("a").isEmpty() and catalog.reload("a", 1).count() == 10
    with pytest.raises(ValueError):
        catalog.reload("a")


def _events(spark, n):
    return spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("UPLOAD").alias("event_type"), F.lit("x").alias("actor"),
        F.lit("d").alias("dataset_id"), F.lit(None).cast("string").alias("decision_id"),
        F.create_map(F.lit("n"), F.col("id").cast("string")).alias("details"), F.timestamp_seconds("id").alias("ts"))


def test_a_batch_appended_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for part in ("ts < '1970-01-01 00:00:50'", "ts >= '1970-01-01 00:00:50'", "ts < '1970-01-01 00:00:50'"):
        L.append_events(_events(spark, 120).where(part).repartition(3), path)
    assert spark.read.parquet(path).count() == 120


@pytest.mark.parametrize("blocks", [6, 2500])
def test_proofs(spark, blocks, tmp_path):
    ledger = _events(spark, 3000 if blocks > 10 else 300)
    L.hash_tree(ledger, blocks).write.parquet(str(tmp_path / "tree"))
    tree = spark.read.parquet(str(tmp_path / "tree"))
    event = ledger.where("details['n'] = '77'").select("id", L.leaf_hash().alias("leaf")).first()
    path = L.inclusion_path(tree, event["id"])
    assert path.where("own").count() == (2 if blocks <= L.FAN_OUT else 3)
    held = L.proof(path, event["leaf"], "before").first()
    assert held["valid"] and held["batch_root"] == L.batch_root(L.block_roots(ledger, blocks), blocks, "before").first()["batch_root"]
    assert not L.proof(path, "0" * 64).first()["valid"]
    assert not L.proof(L.inclusion_path(tree, "absent"), event["leaf"]).first()["valid"]
    changed = ledger.withColumn("actor", F.when(F.col("id") == event["id"], "y").otherwise(F.col("actor")))
    assert L.altered_blocks(tree, ledger, blocks).isEmpty()
    bad = L.altered_blocks(tree, changed, blocks).collect()
    assert [r["block"] for r in bad] == [int(event["id"][:8], 16) % blocks]
    assert [tuple(r) for r in L.altered_events(tree, changed, blocks).collect()] == [(event["id"], bad[0]["block"], "changed")]
