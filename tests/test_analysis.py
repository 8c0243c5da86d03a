import pytest
from pyspark.sql import functions as F

from cellwarden.operators import decide as D
from cellwarden.operators import report as RP
from cellwarden.operators.detect import row_evidence
from cellwarden.plans.analyze import analyze
from tests.tables import OUTCOMES, frame


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name in OUTCOMES:
        out[name] = analyze(frame(spark, name), "row_id", name, parity=True)
    return out


@pytest.mark.parametrize("name", list(OUTCOMES))
def test_acceptance_tables(results, name):
    rows = results[name].decisions.collect()
    by = lambda d, u: sum(r["decision"] == d and r["uncertainty_type"] == u for r in rows)
    got = (sum(r["evidence_count"] for r in rows), len(rows), by("AUTO", None),
           by("ESCALATE", "policy"), by("ESCALATE", "authority"))
    assert got == OUTCOMES[name]


def _cell(results, name, row, column):
    return next(r for r in results[name].decisions.collect() if (r["row_id"], r["column"]) == (row, column))


@pytest.mark.parametrize("name, row, column, values, new", [
    ("V1", 0, "name", (0.95, 0, 0.05, 0), "Nguyen Van A"),
    ("V2", 3, "hire_date", (0.5, 0, 0.5, 0), ""),
    ("V3", 5, "email", (0.8889, 0, 0.1111, 0), "a@company.com"),
    ("V4", 2, "salary", (0.1661, 0.5003, 0.3336, 0.1994), None),
    ("DEMO", 4, "salary", (0.9693, 0.0184, 0.0123, 0.5925), None),
    ("DEMO", 6, "department", (0.9524, 0, 0.0476, 0), "Engineering"),
    ("DEMO", 8, "salary", (0.7826, 0.1304, 0.087, 0.54), None),
])
def test_selected_cells(results, name, row, column, values, new):
    r = _cell(results, name, row, column)
    got = (r["belief_error"], r["belief_clean"], r["ignorance"], r["conflict_k"])
    assert got == pytest.approx(values, abs=1e-4)
    assert r["new_value"] == new


def test_dependencies_of_v5(results):
    assert results["V5"].fds == [("type", "status", 1.0), ("status", "type", 1.0)]


def test_verify_cases_pass(spark, results):
    decisions = results["V1"].decisions
    for n in ("V2", "V3", "V4", "V5"):
        decisions = decisions.unionByName(results[n].decisions)
    cases = spark.createDataFrame(
        [("V1", "V1", "AUTO"), ("V2", "V2", "AUTO"), ("V3", "V3", "AUTO"), ("V4", "V4", "ESCALATE"),
         ("V5", "V5", "ESCALATE")], "case_id string, dataset_id string, accepted string")
    assert tuple(RP.verify_summary(RP.verify_cases(cases, decisions)).first()) == (5, 5, True)


def test_safe_mode_normalizes_dates_and_leaves_emails(spark):
    dates = analyze(frame(spark, "V2"), "row_id", "v2").decisions.collect()
    assert {r["row_id"]: r["new_value"] for r in dates} == {1: "2024-01-15", 3: "2024-02-20", 5: "2024-03-10"}
    emails = analyze(frame(spark, "V3"), "row_id", "v3").decisions.collect()
    assert all(r["decision"] == "ESCALATE" for r in emails)


def test_repair_changes_automatic_cells_only(spark):
    df = frame(spark, "DEMO")
    a = analyze(df, "row_id", "demo")
    auto = {(r["row_id"], r["column"]) for r in a.decisions.collect() if r["decision"] == "AUTO" and r["new_value"]}
    before = {r["row_id"]: r.asDict() for r in df.collect()}
    after = {r["row_id"]: r.asDict() for r in a.repaired().collect()}
    changed = {(i, c) for i in before for c in before[i] if before[i][c] != after[i][c]}
    assert changed == auto
    assert a.repaired().schema == a.table.schema
    again = row_evidence(a.repaired(), a.stats, ("whitespace_detector",))
    assert again.count() == 0


def test_same_result_for_any_partitioning(spark):
    df = frame(spark, "DEMO")
    runs = [
        sorted(map(str, analyze(part, "row_id", "demo").decisions.collect()))
        for part in (df.coalesce(1), df.orderBy(F.desc("row_id")).repartition(7))
    ]
    assert runs[0] == runs[1]


def test_questions_for_every_escalation(results):
    rows = results["V4"].decisions.select("decision", D.question().alias("q")).collect()
    assert all("salary" in r["q"] and "high_value_data" in r["q"] for r in rows if r["decision"] == "ESCALATE")


EDGES = {
    "empty": ("row_id bigint, a string, b double", []),
    "one_row": ("row_id bigint, a string, b double", [(0, " x ", 1.0)]),
    "all_null": ("row_id bigint, a string, b double", [(i, None, None) for i in range(6)]),
    "constant": ("row_id bigint, a string, b double", [(i, "k", 2.0) for i in range(6)]),
    "nan": ("row_id bigint, a string, b double", [(i, "k", float("nan") if i == 3 else float(i)) for i in range(8)]),
    "mixed": ("row_id bigint, a array<int>, b decimal(30,2), c timestamp, d boolean",
              [(i, [i % 2], None, None, i > 2) for i in range(6)]),
}


@pytest.mark.parametrize("name, found", [
    ("empty", {}), ("one_row", {"whitespace_detector": 1}), ("all_null", {"null_detector": 12}),
    ("constant", {}), ("nan", {}), ("mixed", {"null_detector": 12}),
])
def test_edge_tables(spark, name, found):
    schema, rows = EDGES[name]
    a = analyze(spark.createDataFrame(rows, schema), "row_id", name)
    got = {r["detector"]: r["count"] for r in a.evidence.groupBy("detector").count().collect()}
    got.pop("duplicate_key_detector", None) if name == "mixed" else None
    assert got == found
