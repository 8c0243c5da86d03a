"""The paths taken only on large or skewed data give the plain results."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwarden.operators import relate as R
from cellwarden.operators.cells import with_row_id
from cellwarden.operators.skew import join_groups
from cellwarden.operators.stats import exact_quantiles, fit


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    plain = rows.join(groups, "k").select("row_id", "k", "n")
    salted = join_groups(rows, groups, ["k"], "n", "row_id", rows_per_task=100).select("row_id", "k", "n")
    assert sorted(plain.collect()) == sorted(salted.collect())


@pytest.mark.parametrize("kind", ["uniform", "hot", "skewed", "tiny", "many"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.random(5000), "skewed": np.exp(rng.normal(0, 4, 5000)),
        "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.random(5000) * 20), "tiny": np.array([3.0, 1.0, 2.0]),
        "many": np.round(rng.normal(0, 50, 250_000), 2),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
    assert len(got) == 5


def _dirty(spark, n=4000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        x = 0 if rng.random() < 0.34 else rng.randint(1, 60)
        y = f"y{x}" if rng.random() < 0.97 else f"y{rng.randint(0, 60)}"
        rows.append((i, x, y, rng.randint(0, 5), f"code{i if i % 9 else 0}", rng.choice(["ab", "cd", "ef"])))
    return spark.createDataFrame(rows, "row_id bigint, x int, y string, z int, code string, s string")


def _brute_fds(pdf, columns):
    n, out = len(pdf), {}
    for x in columns:
        sizes = pdf.groupby(x)[x].transform("size")
        if not 1 < pdf[x].nunique() < 0.9 * n or (sizes >= 3).sum() < 0.3 * n:
            continue
        sub = pdf[sizes >= 3]
        for y in columns:
            if y == x or pdf[y].nunique() <= 1 or pdf[y].value_counts(normalize=True).iloc[0] >= 0.9:
                continue
            conf = sub.groupby(x)[y].agg(lambda s: s.value_counts().iloc[0]).sum() / len(sub)
            if conf >= 0.9:
                out[x, y] = round(conf, 9)
    return out


def test_dependency_mining_equals_brute_force_with_and_without_first_step(spark):
    df = _dirty(spark)
    names = ["x", "y", "z", "code", "s"]
    stats = fit(df, names)
    want = _brute_fds(df.toPandas(), names)
    assert ("x", "y") in want
    for share, least in ((None, 0), (4, 0), (2, 0)):
        found = R.mine_fds(df, stats, share, least)
        assert {(r["x"], r["y"]): round(r["confidence"], 9) for r in found.collect()} == want


def _rows(df):
    return sorted(map(str, df.collect()))


def test_hot_groups_give_the_same_evidence(spark):
    df = _dirty(spark)
    names = ["x", "y", "z", "code", "s"]
    stats = fit(df, names)
    fds = [("x", "y", 0.97)]
    assert _rows(R.fd_violations(df, stats, fds)) == _rows(R.fd_violations(df, stats, fds, rows_per_task=7))
    assert _rows(R.duplicate_keys(df, stats, names=["code"])) == _rows(
        R.duplicate_keys(df, stats, names=["code"], rows_per_task=7))
    assert R.duplicate_keys(df, stats, names=["code"]).count() == sum(1 for i in range(4000) if i % 9 == 0)
    mixed = df.withColumn("s", F.when(F.col("row_id") % 37 == 0, F.concat("s", F.col("row_id").cast("string"), F.lit("-"))).otherwise(F.col("s")))
    stats = fit(mixed, ["s"])
    plain = R.rare_patterns(mixed, stats)
    assert plain.count() == 109
    assert _rows(plain) == _rows(R.rare_patterns(mixed, stats, rows_per_task=3))


def test_long_texts_are_compared_whole(spark):
    base = "lorem ipsum dolor sit amet " * 40
    typo = base[:600] + "X" + base[601:]
    other = base[:500] + "different ending " * 60
    df = spark.createDataFrame([(i, v) for i, v in enumerate([base, base, typo, other, "x"])], "row_id bigint, t string")
    found = R.near_duplicates(df, fit(df, ["t"])).collect()
    assert [(r["row_id"], r["expected_value"] == base) for r in found] == [(2, True)]


def test_first_canonical_wins_over_closer_one(spark):
    values = ["abcdefghij", "abcdefghik", "abcdefghij", "abcdefghik", "abcdefghikk"]
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, t string")
    r = R.near_duplicates(df, fit(df, ["t"])).first()
    assert (r["row_id"], r["expected_value"]) == (4, "abcdefghij")


def test_duplicate_key_details_and_limit(spark):
    df = spark.createDataFrame([(i, f"k{i // 2 if i < 40 else i}") for i in range(80)], "row_id bigint, code string")
    stats = fit(df, ["code"])
    assert R.duplicate_keys(df, stats, max_values=3).count() == 6
    r = R.duplicate_keys(df, stats, details=True).orderBy("row_id").first()
    assert r["details"]["duplicate_rows"] == "[0,1]"


def test_text_classes_of_long_values(spark):
    long_number = "1" * 90
    df = spark.createDataFrame([(i, v) for i, v in enumerate([long_number, long_number, "7", " " * 70 + "n/a", "x"])],
                               "row_id bigint, t string")
    s = fit(df, ["t"]).columns["t"]
    assert (s.n_distinct, s.integer_hits, s.null_tokens, s.max_length) == (4, 3, 1, 90)


def test_row_ids_come_from_the_key(spark):
    df = spark.createDataFrame([(5, "a")], "k int, v string")
    assert with_row_id(df, "k").first()["row_id"] == 5


def test_narrowed_brackets_keep_the_quantiles(spark, monkeypatch):
    from cellwarden.operators import stats as S

    values = np.random.default_rng(8).lognormal(0, 3, 250_000)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    probabilities = (0.25, 0.5, 0.999)
    wide = S.quantile_brackets(df, ["x"], probabilities)
    monkeypatch.setattr(S, "BRACKET_ROWS", 1)
    assert S.quantile_brackets(df, ["x"], probabilities) == wide  # too few rows per step
    monkeypatch.setattr(S, "BRACKET_STEPS", 4)
    narrow = S.quantile_brackets(df, ["x"], probabilities)
    assert all(narrow[k][1] - narrow[k][0] < wide[k][1] - wide[k][0] for k in wide)
    for r in exact_quantiles(df, ["x"], probabilities).collect():
        assert r["value"] == pytest.approx(np.percentile(values, r["p"] * 100), rel=1e-12)
