"""Drift profiles and conformal thresholds against plain Python, and the gate rules they reach."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from cellwarden.operators import calibrate as K
from cellwarden.operators import decide as D
from cellwarden.operators import drift as DR
from cellwarden.operators import review as RV
from cellwarden.plans.analyze import analyze

REVIEWED = "family string, belief_error double, is_error boolean"


def outcomes(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        wrong = rng.random() < 0.6
        belief = min(1.0, max(0.0, rng.gauss(0.7 if wrong else 0.4, 0.2)))
        rows.append((rng.choice(["fd", "pattern"]), round(belief, 4), wrong))
    return rows


def test_thresholds_are_the_ranked_scores(spark):
    rows = outcomes(500, 1) + [("rare", 0.9, True)]
    got = {(r["family"], r["is_error"]): (r["n"], r["threshold"]) for r in K.thresholds(spark.createDataFrame(rows, REVIEWED)).collect()}
    groups = collections.defaultdict(list)
    for family, belief, wrong in rows:
        groups[family, wrong].append(round(1 - belief if wrong else belief, 4))
    assert set(got) == set(groups)
    for key, scores in groups.items():
        rank = math.ceil(round((len(scores) + 1) * 0.9, 9))
        want = sorted(scores)[rank - 1] if rank <= len(scores) else None
        assert got[key] == (len(scores), want)
    assert got["rare", True] == (1, None)  # one review bounds nothing


@pytest.mark.parametrize("alpha", [0.05, 0.1, 0.3])
def test_held_out_coverage(spark, alpha):
    limits = K.thresholds(spark.createDataFrame(outcomes(3000, 2), REVIEWED), alpha)
    for r in K.coverage(spark.createDataFrame(outcomes(3000, 3), REVIEWED), limits).collect():
        assert abs(r["covered"] / r["n"] - (1 - alpha)) < 0.05


def test_prediction_sets(spark):
    limits = spark.createDataFrame([("a", True, 9, 0.3), ("a", False, 9, 0.5), ("b", True, 9, 0.3)],
                                   "family string, is_error boolean, n bigint, threshold double")
    cells = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.1), (3, "a", 0.6), (4, "b", 0.9), (5, "b", 0.1), (6, "new", 0.9)],
                                  "id int, family string, belief_error double")
    got = {r["id"]: (r["admits_error"], r["admits_clean"], r["conformal_abstain"]) for r in K.prediction_sets(cells, limits).collect()}
    assert got == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True),
                   4: (True, True, True), 5: (False, True, False), 6: (True, True, True)}
    with pytest.raises(ValueError):
        K.thresholds(cells, 1)
    assert K.thresholds(spark.createDataFrame([], REVIEWED)).count() == 0


def psi(was, now):
    bins = set(was) | set(now)
    share = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * len(bins))
    return sum((share(now, b) - share(was, b)) * math.log(share(now, b) / share(was, b)) for b in bins)


def test_drift_is_the_stability_index(spark):
    rng = random.Random(4)
    schema = "x double, t string"
    old = [(rng.gauss(0, 1), rng.choice("abc")) for _ in range(400)] + [(None, None), (math.nan, ""), (0.0, "y" * 100)]
    new = [(rng.gauss(2, 1), rng.choice("abd")) for _ in range(300)] + [(None, "a")]
    base = DR.profile(spark.createDataFrame(old, schema), ["x", "t"])
    rows = base.collect()
    edges = next(r["edges"] for r in rows if r["column"] == "x")
    top = set(next(r["top"] for r in rows if r["column"] == "t"))
    assert len(edges) == 9 and top == {"a", "b", "c", ""}

    def number(x):
        return "missing" if x is None else "nan" if math.isnan(x) else f"tenth {sum(x >= e for e in edges)}"

    def text(t):
        return "missing" if t is None else f"value {t}" if t in top else f"length {len(bin(len(t))) - 2}"

    was = {"x": collections.Counter(number(x) for x, _ in old), "t": collections.Counter(text(t) for _, t in old)}
    now = {"x": collections.Counter(number(x) for x, _ in new), "t": collections.Counter(text(t) for _, t in new)}
    assert {(r["column"], r["bin"]): r["n"] for r in rows} == {(c, b): n for c in was for b, n in was[c].items()}
    got = {r["column"]: r["psi"] for r in DR.drift(spark.createDataFrame(new, schema), base).collect()}
    assert got == {c: pytest.approx(psi(was[c], now[c]), abs=1e-5) for c in was}
    assert DR.drifted_columns(spark.createDataFrame(old, schema), base) == []


def test_drift_edges(spark):
    schema = "x int, d date, flag boolean, `a.b` string, empty string"
    names = ["x", "d", "flag", "a.b", "empty"]
    df = spark.createDataFrame([(1, None, True, "u", None)] * 5, schema)
    base = DR.profile(df, names)
    assert base.schema.simpleString().count("array") == 2
    assert {r["psi"] for r in DR.drift(df, base).collect()} == {0.0}
    none = spark.createDataFrame([], schema)
    assert [r["psi"] for r in DR.drift(none, base).collect()] == [None] * 5
    assert DR.profile(none, names).count() == 0 and DR.drift(df, DR.profile(none, names)).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        DR.drift(df.drop("x"), base)


def test_rules_seven_and_eight_are_reached_from_analyze(spark):
    rows = [(i, " padded " if i % 20 == 0 else "plain", f"A{i % 9}-{i}" if i % 50 else "odd!") for i in range(1, 401)]
    df = spark.createDataFrame(rows, "id bigint, label string, code string")
    plain = analyze(df, "id")
    assert {r["rule"] for r in plain.decisions.select("rule").distinct().collect()} <= {3, 5, 6}
    earlier = spark.createDataFrame([(i, "other") for i in range(400)], "id bigint, label string")
    moved = analyze(df, "id", baseline=DR.profile(earlier, ["label"]))
    found = moved.decisions.where("column = 'label'").groupBy("decision", "rule").count().collect()
    assert [(r["decision"], r["rule"]) for r in found] == [("ESCALATE", 7)]
    # Reviews that answer both ways at the same belief leave no single answer.
    context = D.gate_context(plain.evidence)
    open_cells = plain.decisions.where("decision = 'ESCALATE'")
    reviews = open_cells.select("decision_id", F.when(F.col("row_id") % 100 == 0, "REJECT").otherwise("APPROVE").alias("action"),
                                F.lit(None).cast("string").alias("edited_value"), F.lit("").alias("comment"), F.lit("r").alias("reviewer"),
                                F.lit(1.0).alias("confidence"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    reviewed = K.outcomes(context, RV.submit(reviews))
    assert reviewed.count() == open_cells.count() > 0
    family = reviewed.select("family").first()[0]
    asked = analyze(df, "id", limits=K.thresholds(reviewed), policies=[family])
    rules = {r["rule"] for r in asked.decisions.select("rule").distinct().collect()}
    assert 8 in rules
    kept = asked.decisions.join(plain.decisions.select("decision_id", F.col("belief_error").alias("b")), "decision_id")
    assert kept.where("belief_error = b").count() == plain.decisions.count()
