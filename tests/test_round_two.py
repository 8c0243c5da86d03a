"""Key checks, CSV quoting, edit order and uncapped near duplicates."""

import random

import pytest
from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.operators import relate as R
from cellwarden.operators import repair
from cellwarden.operators.stats import fit
from cellwarden.plans.analyze import analyze
from cellwarden.sources import files


@pytest.mark.parametrize("keys", [[1, 1, 2], [1, None, 2], ["a", "b", "c"]])
def test_unsafe_keys_are_refused(spark, keys):
    kind = "string" if isinstance(keys[0], str) else "bigint"
    df = spark.createDataFrame([(k, " a") for k in keys], f"k {kind}, v string")
    with pytest.raises(ValueError, match="not unique"):
        analyze(df, "k")


def test_key_column_is_not_checked(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(12)], "k bigint, v string")
    assert analyze(df, "k").columns == ["v"]


def test_csv_quotes_breaks_and_repeated_names(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b,a\n1,"line one\nline two",x\n2,"say ""hi"", ok",y\n3,,z\n')
    got = [tuple(r) for r in files.read_csv(spark, str(path)).orderBy("a").collect()]
    assert got == [(1, "line one\nline two", "x"), (2, 'say "hi", ok', "y"), (3, None, "z")]
    assert files.read_csv(spark, str(path)).columns == ["a", "b", "a_1"]
    names = files.header_names(spark, str(path), {"sep": ",", "multiLine": True})
    assert files.warnings(files.read_csv(spark, str(path)), names) == ["Duplicate column names detected"]


def test_the_last_edit_of_a_cell_wins(spark):
    df = spark.createDataFrame([(1, "x")], "row_id bigint, v string")
    edits = spark.createDataFrame([(2, 1, "v", "10"), (1, 1, "v", "9")], "command_id int, row_id bigint, column string, new_value string")
    assert repair.apply_repairs(df, edits, ["v"]).first()["v"] == "10"


def test_near_duplicates_beyond_500_values(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 16))) for _ in range(700)]
    values = [*words, *words[:150]]
    for w in words[:150]:
        at = rng.randrange(len(w) + 1)
        values.append(w[:at] + rng.choice(["", "z", "zz"]) + w[at + rng.randrange(2):])
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, t string")
    stats = fit(df, ["t"])
    assert stats.columns["t"].n_distinct > 500
    got = {r["row_id"]: r["expected_value"] for r in R.near_duplicates(df, stats).collect()}
    assert R.near_duplicates(df, stats, max_distinct=500) is None

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    first, n = {}, {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
        n[v] = n.get(v, 0) + 1
    want = {}
    for v, i in first.items():
        if n[v] == 1:
            near = [(first[c], c) for c in n if n[c] > 1 and 0.85 <= ratio(v, c) < 1]
            if near:
                want[i] = min(near)[1]
    assert got == want and len(want) > 50


def test_whole_analysis_searches_columns_of_any_number_of_values(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from workload.cell_queries import _part_labels

    sf = "/root/testdata/sf0.01"
    labels = _part_labels(spark, sf)
    assert labels.select("label").distinct().count() > C.NEAR_DUP_MAX_DISTINCT
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    want = {(r[0], r[1], r[2], float(r[3])) for r in con.execute(
        f"SELECT row_id, val, canon, score FROM ({entry.oracle_sql()['pl1b_near_duplicate_text']})").fetchall()}
    got = {tuple(r) for r in entry.queries()["pl1b_near_duplicate_text"](spark, sf).collect()}
    assert got == want and got
    capped = analyze(labels, "row_id", "part_labels", parity=True).evidence
    assert capped.where("detector = 'near_duplicate_detector'").isEmpty()
