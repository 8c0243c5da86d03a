"""Findings of round 3, second pass: the first step of dependency mining."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cellwarden.operators import relate as R
from cellwarden.operators.stats import fit


def _table(spark, n=70_000):
    """x and hot repeat often enough for every way of packing; y depends on x but for some rows."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row_id"),
        F.floor(i / 20).alias("few"),
        F.when(i % 41 > 0, F.floor(i / 600)).alias("x"),
        F.when(i < 40_000, 7).otherwise(i % 5).alias("hot"),
        F.when(i % 29 == 0, F.lit("N/A")).when(i % 50 == 0, F.concat(F.lit("z"), i)).otherwise(
            F.concat(F.lit("y"), F.floor(i / 600))).alias("y"),
        F.when(i % 31 == 0, float("nan")).otherwise((F.xxhash64("id") % 9).cast("double")).alias("noise"))


def test_first_step_never_overstates_violations_and_leaves_few_pairs(spark, monkeypatch):
    df = _table(spark).localCheckpoint()
    names = ["few", "x", "hot", "y", "noise"]
    stats = fit(df, names)
    assert {next(b for b, _ in R.FD_PACKED if stats.columns[c].top_count < 1 << b) for c in ("few", "x", "hot")} == {7, 15, 31}
    pairs = R.fd_pairs(stats)
    rows = [r.asDict() for r in df.collect()]
    bounds = R._least_violations(df, stats, pairs, 1)
    for x, y in pairs:
        groups = defaultdict(Counter)
        keys = [None if r[x] is None else str(r[x]) for r in rows]  # NaN is a value of x, but none of y
        sizes = Counter(k for k in keys if k is not None)
        for k, r in zip(keys, rows):
            if sizes[k] >= 3 and r[y] not in (None, "N/A") and r[y] == r[y]:
                groups[k][r[y]] += 1
        violations = sum(sum(g.values()) - max(g.values()) for g in groups.values())
        assert 0 <= bounds[x, y] <= violations
        assert bounds[x, y] >= violations / 2  # no two of so many values always share a bucket
    counted = []
    whole = R._pair_counts
    monkeypatch.setattr(R, "_pair_counts", lambda df, stats, pairs, *a: counted.append(pairs) or whole(df, stats, pairs, *a))
    found = {(r["x"], r["y"]) for r in R.mine_fds(df, stats).collect()}
    assert found == {(r["x"], r["y"]) for r in R.mine_fds(df, stats, first_share=None).collect()} >= {("x", "y"), ("few", "y")}
    part, rest, everything = counted  # the first step leaves few pairs to be counted by value
    assert found <= set(rest) <= set(part) and len(part) < len(everything) == len(pairs)
