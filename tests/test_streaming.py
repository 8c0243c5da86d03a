from pyspark.sql import functions as F

from cellwarden.operators.decide import decide, gate_context
from cellwarden.operators.evidence import describe
from cellwarden.operators.detect import row_evidence
from cellwarden.operators.stats import fit
from cellwarden.streaming import detect as ST


def _source(spark, path):
    """Events in several files, so that a stream takes several batches."""
    df = spark.range(400).select(
        F.col("id").alias("row_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        (F.col("id") % 90).alias("k"),
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 61 == 0, 1000.0).otherwise(F.col("id") % 7 + 0.5).alias("value"))
    for i in range(4):  # one after the other, so that the files' times follow the events
        df.where(F.floor(F.col("row_id") / 100) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_decides_like_the_batch(spark, tmp_path):
    static, stream = _source(spark, str(tmp_path / "in"))
    baseline = fit(static, ["value"])
    ST.run_detection(stream, baseline, "s", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    want = decide(gate_context(describe(row_evidence(static, baseline, ST.STREAM_DETECTORS), "s")))
    key = lambda df: sorted(map(tuple, df.select("decision_id", "decision", "belief_error").collect()))
    assert key(got) == key(want) and want.count() == 8 + 7 - 1


def _run(stream, tmp_path, mode):
    rows = []
    (stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
     .foreachBatch(lambda df, i: rows.extend(df.collect())).trigger(availableNow=True).start().awaitTermination())
    return rows


def test_stream_quality_windows(spark, tmp_path):
    static, stream = _source(spark, str(tmp_path / "in"))
    baseline = fit(static, ["value"])
    rows = _run(ST.quality_metrics(stream, baseline, "value", "ts", "1 hour", "1 minute"), tmp_path, "append")
    want = {r["window_start"]: r for r in ST.quality_metrics(static, baseline, "value", "ts", "1 hour").collect()}
    assert len(rows) >= 5 and all(want[r["window_start"]] == r for r in rows)


def test_stream_duplicates(spark, tmp_path):
    _, stream = _source(spark, str(tmp_path / "in"))
    rows = _run(ST.stream_distinct(stream, ["k"], "ts", "30 days").select("k"), tmp_path, "append")
    assert sorted(r["k"] for r in rows) == list(range(90))


def test_stream_key_counts(spark, tmp_path):
    _, stream = _source(spark, str(tmp_path / "in"))
    rows = _run(ST.stream_key_counts(stream, "k", "ts", "1 minute", "3 hours"), tmp_path, "append")
    assert rows and all(r["copies"] == 2 for r in rows)
