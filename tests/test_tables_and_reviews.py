import hashlib

import pytest
from pyspark.sql import functions as F

from cellwarden.operators import commands, ledger, profile, repair, review
from cellwarden.sources import files
from cellwarden.sources.catalog import Catalog, write_cleaned
from tests.tables import frame


def test_csv_types_and_ragged_lines(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,v,phone,d\n1,1.5,0901,2024-01-02\n2,,0902,2024-01-03,extra\n3\n")
    df = files.read_table(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "phone": "bigint", "d": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 1.5, 901, "2024-01-02"), (2, None, 902, "2024-01-03"), (3, None, None, None)]
    kept = files.read_csv(spark, str(p), keep_leading_zeros=True)
    assert dict(kept.dtypes)["phone"] == "string"


def test_tsv_names_and_warnings(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("a\n x \n")
    df = files.read_table(spark, str(p))
    assert df.first()["a"] == " x "
    assert len(files.warnings(df)) == 1
    assert files.warnings(df.limit(0))[0].startswith("Dataset is empty")
    assert files.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]


def test_unknown_suffix_is_refused(spark):
    with pytest.raises(ValueError):
        files.read_table(spark, "x.txt")


def test_fingerprints(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"a,b\n1,2\n")
    r = files.fingerprints(spark, str(tmp_path)).first()
    assert (r["sha256"], r["file_size_bytes"]) == (hashlib.sha256(b"a,b\n1,2\n").hexdigest(), 8)


def test_row_numbers_follow_the_file(spark):
    df = files.number_rows(spark.range(0, 100, 1, 7).withColumn("v", F.col("id") * 2))
    assert all(r["row_id"] == r["id"] for r in df.collect())


def test_small_input_is_spread(spark):
    big = spark.range(1 << 40)
    assert files.spread(big) is big
    assert files.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


MESSAGES = [
    ("Bác bỏ dòng 3", ("REJECT", 3, None, None)),
    ("duyệt dòng 0 nhé", ("APPROVE", 0, None, None)),
    ("Sửa dòng 2 cột salary thành 25 triệu", ("EDIT", 2, "salary", "25000000")),
    ("dòng 4 sửa lương thành 18000000", ("EDIT", 4, "lương", "18000000")),
    ("thay đổi các giá trị đó thành 10 điểm cho tôi", ("BATCH_EDIT", None, None, "10")),
    ("cập nhật cột math score thành 7.5 điểm", ("BATCH_EDIT", None, "math score", "7.5")),
    ("update salary = 1.5 triệu", ("BATCH_EDIT", None, "salary", "1500000")),
]


def test_edit_commands(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MESSAGES)] + [(99, "xin chào")], "i int, text string")
    got = {r["i"]: (r["action"], r["row_id"], r["column"], r["new_value"])
           for r in commands.extract_edit_commands(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(MESSAGES)}


def test_edits_resolve_names_and_never_guess(spark):
    decisions = spark.createDataFrame([(1, "email", "ESCALATE"), (1, "salary", "AUTO")],
                                      "row_id bigint, column string, decision string")
    cmds = spark.createDataFrame([(0, 7, "lương", "5", "EDIT"), (1, 1, None, "x", "EDIT"), (2, 9, None, "x", "EDIT")],
                                 "command_id int, row_id bigint, column string, new_value string, action string")
    got = repair.resolve_edits(cmds, decisions, ["salary", "email"]).collect()
    assert {(r["command_id"], r["column"]) for r in got} == {(0, "salary"), (1, "salary")}


def test_edits_keep_types_and_ignore_strangers(spark):
    df = frame(spark, "V4")
    edits = spark.createDataFrame([(0, "salary", "1"), (1, "salary", "abc"), (77, "salary", "5"), (2, "nope", "x"),
                                   (3, "name", "N")], "row_id bigint, column string, new_value string")
    cols = [c for c in df.columns if c != "row_id"]
    got = {r["row_id"]: r for r in repair.apply_repairs(df, edits, cols).collect()}
    assert len(got) == 5
    assert (got[0]["salary"], got[1]["salary"], got[3]["name"]) == (1, 18000000, "N")
    changes = {(r["row_id"], r["column"], r["old_value"], r["new_value"])
               for r in repair.change_set(df, edits, cols).collect()}
    assert changes == {(0, "salary", "15000000", "1"), (3, "name", "Pham Thi D", "N")}


def test_review_last_write_wins_and_edit_needs_a_value(spark):
    decisions = spark.createDataFrame([("d1", "ESCALATE"), ("d2", "ESCALATE"), ("d3", "AUTO")],
                                      "decision_id string, decision string")
    raw = spark.createDataFrame(
        [("d1", "APPROVE", None, 1), ("d1", "REJECT", None, 2), ("d2", "EDIT", "", 3)],
        "decision_id string, action string, edited_value string, t int"
    ).select("decision_id", "action", "edited_value", F.lit("").alias("comment"), F.lit("r").alias("reviewer"),
             F.lit(1.0).alias("confidence"), F.timestamp_seconds("t").alias("ts"))
    reviews = review.submit(raw)
    queue = review.review_queue(decisions, reviews)
    assert {(r["decision_id"], r["reviewed"], r["review_action"]) for r in queue.collect()} == {
        ("d1", True, "REJECT"), ("d2", False, None)}
    assert tuple(review.queue_counts(queue).first()) == (2, 1, 1)
    assert review.review_queue(decisions, reviews, "pending").first()["decision_id"] == "d2"
    assert review.review_queue(decisions, reviews, "reviewed").count() == 1
    assert ledger.review_events(reviews).where("actor = 'user:r'").count() == 2


def test_ledger_tampering_changes_the_root(spark, tmp_path):
    base = spark.range(200).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("AUTO").alias("event_type"),
        F.lit("system").alias("actor"), F.lit("d").alias("dataset_id"), F.lit(None).cast("string").alias("decision_id"),
        F.create_map(F.lit("n"), F.col("id").cast("string")).alias("details"), F.timestamp_seconds("id").alias("ts"))
    path = str(tmp_path / "ledger")
    ledger.append_events(base, path)
    stored = spark.read.parquet(path)
    root = lambda df, prev="": ledger.batch_root(ledger.block_roots(df, 8), 8, prev).first()["batch_root"]
    assert root(stored) == root(base.repartition(5))
    changed = base.withColumn("details", F.when(F.col("details")["n"] == "7", F.create_map(F.lit("n"), F.lit("8"))).otherwise(F.col("details")))
    assert root(changed) != root(base)
    assert root(base, "x") != root(base)
    many = ledger.block_count(base, 1)
    deep = ledger.batch_root(ledger.block_roots(base, many * 20), many * 20).first()
    assert deep["events"] == 200 and deep["batch_root"] != root(base)
    assert ledger.query_events(stored, "d", limit=3, offset=1).count() == 3
    assert ledger.timeline(stored, "d").first()["details"]["n"] == "0"


def test_capped_events(spark):
    decisions = spark.range(50).select(
        F.lit("d").alias("dataset_id"), F.col("id").cast("string").alias("decision_id"), F.col("id").alias("row_id"),
        F.lit("c").alias("column"), F.lit("AUTO").alias("decision"), F.lit(0.5).alias("belief_error"), F.lit(0.0).alias("conflict_k"))
    events = ledger.capped_decision_events(decisions, F.lit("2024-01-01").cast("timestamp"), cap=10).collect()
    assert len(events) == 11
    assert [e["details"]["total_decisions"] for e in events if e["event_type"] == "BATCH_DECISIONS"] == ["50"]


def test_catalog_register_reload_delete(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    summary = spark.createDataFrame([("a", 1)], "dataset_id string, auto_count int")
    decisions = spark.createDataFrame([("a", "x"), ("a", "y")], "dataset_id string, column string")
    c.register("a", summary, decisions, "2024-01-01 00:00:00")
    c.register("a", summary, decisions, "2024-01-02 00:00:00")
    assert c.datasets().count() == 1 and c.decisions("a").count() == 2
    c.delete("a", "2024-01-03 00:00:00")
    assert c.datasets().count() == 0 and c.decisions("a").count() == 0
    c.register("a", summary, decisions, "2024-01-04 00:00:00")
    assert c.dataset("a").count() == 1


def test_cleaned_table_never_overwrites(spark, tmp_path):
    path = write_cleaned(frame(spark, "V1"), str(tmp_path), "v1", 1, "csv")
    assert files.read_csv(spark, path).count() == 5
    with pytest.raises(Exception):
        write_cleaned(frame(spark, "V1"), str(tmp_path), "v1", 1, "csv")


def test_profile_of_demo(spark):
    df = frame(spark, "DEMO")
    cols = [c for c in df.columns if c != "row_id"]
    got = {r["column"]: r for r in profile.profile(df, cols, "demo").collect()}
    assert got["email"]["semantic_type"] == "email" and got["email"]["semantic_confidence"] == 0.7
    assert got["phone"]["observed_type"] == "integer" and got["phone"]["missing_rate"] == pytest.approx(0.0833)
    assert got["email"]["missing_rate"] == pytest.approx(0.0833)
    assert got["phone"]["cardinality"] == 11 and got["employee_id"]["cardinality"] == 11
    assert got["hire_date"]["date_likelihood"] == 0.7
    assert got["status"]["pattern_distribution"] == {"Aa": 0.9167, "a": 0.0833}
    assert len(got["status"]["examples"]) == 5


def test_iso_dates_count_as_phone_first(spark):
    df = spark.createDataFrame([(i, f"2024-01-{10 + i}") for i in range(5)], "row_id bigint, z string")
    assert profile.semantic_types(df, ["z"]).first()["semantic_type"] == "phone"
    assert profile.pii_likelihood(df, ["z"]).first()["pii_likelihood"] == 1.0


def test_table_semantics(spark):
    df = frame(spark, "DEMO")
    cat = spark.createDataFrame([("demo", c, i) for i, c in enumerate(df.columns[1:])],
                                "dataset_id string, column string, position int")
    r = profile.table_semantics(cat).first()
    assert r["domain_id"] == "hr_payroll" and r["primary_key_column"] == "employee_id"
    assert r["temporal_column"] == "hire_date" and r["sensitive_columns"] == ["salary", "phone"]
