import math
import random

import pytest
from pyspark.sql import functions as F

from cellwarden.functions import dates, masses, similarity, text
from cellwarden.functions.gate import gate
from cellwarden.operators import fusion


def _column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr).collect()]


def test_shape_collapses_runs_of_each_class(spark):
    got = _column(spark, ["Birmingham 35235", "AbC\t　d", "é1É22", "", "--"], text.shape("v"))
    assert got == ["Aa 9", "AaA a", "é9É9", "", "--"]


def test_strip_covers_unicode_whitespace(spark):
    assert _column(spark, ["　 x ", "\x1fy\x85", " "], text.strip("v")) == ["x", "y", ""]


def test_null_tokens_ignore_case_and_space(spark):
    assert _column(spark, [" N/A ", "Unknown", "n/d", "x", None], text.is_null_token("v")) == [
        True, True, True, False, None]


@pytest.mark.parametrize("value, iso", [
    ("15/01/2024", "2024-01-15"), ("02/15/2024", "2024-02-15"), ("20-02-2024", "2024-02-20"),
    ("1.2.2024", "2024-02-01"), ("2024/01/02", "2024-01-02"), ("2024-02-30", None),
    ("1/2/24", None), ("31/31/2024", None), ("soon", None), ("2024-03-10", "2024-03-10"),
])
def test_iso_dates(spark, value, iso):
    assert _column(spark, [value], dates.to_iso_date("v")) == [iso]


def _brute_ratio(a, b):
    a, b = a.lower(), b.lower()
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(a) + len(b))


def test_similarity_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdÉ ") for _ in range(n))
    pairs = [(word(rng.randint(1, 90)), word(rng.randint(1, 90))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", similarity.indel_ratio("a", "b").alias("s"),
                     similarity.indel_ratio_long("a", "b").alias("l")).collect()
    for r in rows:
        want = _brute_ratio(r["a"], r["b"])
        assert r["l"] == pytest.approx(want)
        if min(len(r["a"]), len(r["b"])) <= similarity.WORD_BITS:
            assert r["s"] == pytest.approx(want)
        else:
            assert r["s"] is None


def test_masses_sum_to_one(spark):
    df = spark.createDataFrame([(a / 10, b / 10) for a in range(11) for b in range(11)], "p double, n double")
    m = masses.masses(masses.weight("p"), masses.weight("n"))
    for r in df.select("p", "n", *[v.alias(k) for k, v in m.items()]).collect():
        assert r["belief_error"] + r["belief_clean"] + r["ignorance"] == pytest.approx(1, abs=1e-9)
        assert r["conflict"] == pytest.approx(min(r["p"], 1 - 1e-6) * min(r["n"], 1 - 1e-6), abs=1e-9)


@pytest.mark.parametrize("items, error, conflict", [
    ([(0.9, "a")], 0.9, 0.0), ([(0.8, "a"), (0.7, "b")], 0.94, 0.0),
    ([(0.9, "a"), (-0.8, "b")], 0.18 / 0.28, 0.72), ([(0.8, "a"), (0.6, "a")], 0.8, 0.0),
])
def test_cell_fusion_by_family(spark, items, error, conflict):
    ev = spark.createDataFrame(
        [(1, "c", f, "possible_error" if s > 0 else "likely_clean", abs(s)) for s, f in items],
        "row_id bigint, column string, family string, claim string, score double")
    r = fusion.fuse_cells(ev).first()
    assert r["belief_error"] == pytest.approx(error)
    assert r["conflict"] == pytest.approx(conflict)


def test_fusion_rejects_unknown_rule(spark):
    with pytest.raises(ValueError):
        fusion.fuse_table(spark.createDataFrame([], "row_id bigint, column string, family string, score double"), rule="x")


def test_fuse_table_without_verdicts_matches_strongest_cell(spark):
    ev = spark.createDataFrame([(1, "a", "f", 0.5), (1, "b", "f", 0.9), (1, "b", "g", 0.5)],
                               "row_id bigint, column string, family string, score double")
    cells, rows = fusion.fuse_table(ev)
    assert {r["column"]: round(r["belief_error"], 6) for r in cells.collect()} == {"a": 0.5, "b": 0.95}
    assert rows.first()["belief_error"] == pytest.approx(0.95)


GATE = [
    ({"unsupported_input": True}, "BLOCK", None, 1),
    ({"security_violation": True}, "BLOCK", None, 2),
    ({"required_authority": 2}, "ESCALATE", "authority", 3),
    ({"action_impact": "HIGH"}, "ESCALATE", "authority", 4),
    ({"repair_deterministic": True, "repair_reversible": True}, "AUTO", None, 5),
    ({}, "ESCALATE", "policy", 6),
    ({"policy_status": "ACTIVE", "out_of_distribution": True}, "ESCALATE", "factual", 7),
    ({"policy_status": "ACTIVE", "conformal_abstain": True}, "ESCALATE", "factual", 8),
    ({"policy_status": "ACTIVE", "conflict": 0.3}, "ESCALATE", "factual", 9),
    ({"policy_status": "ACTIVE", "ignorance": 0.4}, "ESCALATE", "factual", 10),
    ({"policy_status": "ACTIVE"}, "ESCALATE", "factual", 11),
    ({"policy_status": "ACTIVE", "reference_verified": True, "action_impact": "MEDIUM",
      "repair_deterministic": True, "repair_reversible": True}, "AUTO", None, 12),
    ({"policy_status": "ACTIVE", "reference_verified": True, "validated_autonomy": True}, "AUTO", None, 13),
    ({"policy_status": "ACTIVE", "reference_verified": True}, "ESCALATE", "factual", 14),
]


@pytest.mark.parametrize("context, decision, kind, rule", GATE)
def test_gate_rules(spark, context, decision, kind, rule):
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in context.items()} or {"x": F.lit(1)})
    assert tuple(df.select(gate(df.columns).alias("g")).select("g.*").first()) == (decision, kind, rule)


def test_weight_is_bounded(spark):
    w = _column(spark, [0.0, 0.5, 1.0], masses.weight("v"), "double")
    assert w[0] == 0 and w[1] == pytest.approx(math.log(2)) and w[2] == pytest.approx(-math.log(1e-6))
