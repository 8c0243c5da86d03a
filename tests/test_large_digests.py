"""Findings of round 3, F2: files hashed piece by piece, no task over a whole file."""

import hashlib
import random

import pytest

from cellwarden.sources import digests, files

PIECE, ROW = 40_000, 3_000


@pytest.fixture
def small_pieces(spark, monkeypatch):
    monkeypatch.setattr(digests, "PIECE", PIECE)
    monkeypatch.setattr(digests, "ROW", ROW)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(kept, ("17000b", "100b")):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def _files(folder):
    noise = random.Random(3).randbytes(150_000)
    out = {
        "noise.parquet": noise, "ends.csv": noise[:90_000] + b"\n", "a b%20.csv": noise[:100_000] + b"\r",
        "mark.csv": b"\xef\xbb\xbf" + noise[:80_000] + b"x", "mark_ends.csv": b"\xef\xbb\xbf" + noise[5:80_000] + b"\n",
        "breaks.txt": b"\n" * 60_000, "one_line.txt": b"\0\xff" * 70_000, "packed.gz": noise[:70_000],
        "as_large.bin": noise[:PIECE], "larger.bin": noise[:PIECE + 1], "deep/noise.parquet": noise[::-1]}
    (folder / "deep").mkdir()
    for name, data in out.items():
        (folder / name).write_bytes(data)
    return sorted((name.split("/")[-1], len(data), hashlib.sha256(data).hexdigest()) for name, data in out.items())


def _rows(df):
    return sorted((r["file_name"], r["file_size_bytes"], r["sha256"]) for r in df.collect())


def test_digests_of_files_in_pieces(spark, tmp_path, small_pieces):
    expected = _files(tmp_path)
    assert _rows(files.fingerprints(spark, str(tmp_path))) == expected
    rows = digests.split_bytes(spark, str(tmp_path)).groupBy("file", "round").sum("size").collect()
    assert len(rows) > 20  # several pieces a file, each a task's work; a line longer than a piece is in one
    assert all(r["sum(size)"] <= PIECE + 17_000 for r in rows if "one_line" not in r["file"])


def test_files_beyond_the_limit_of_a_row_are_hashed(spark, tmp_path, small_pieces):
    data = random.Random(4).randbytes(100_000)
    (tmp_path / "f.bin").write_bytes(data)
    kept = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50000")  # stands for 2 GB
    try:
        assert _rows(files.fingerprints(spark, str(tmp_path))) == [("f.bin", 100_000, hashlib.sha256(data).hexdigest())]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", kept)


def test_without_openssl_a_file_is_one_tasks_work(spark, tmp_path, small_pieces):
    data = b"\xef\xbb\xbf" + random.Random(5).randbytes(100_000)
    (tmp_path / "f.bin").write_bytes(data)
    found = digests.large_files(spark, str(tmp_path), files._stored, resumed=False).collect()
    assert [r["sha256"] for r in found] == [hashlib.sha256(data).hexdigest()]


def test_a_digest_goes_on_from_a_state():
    data = random.Random(6).randbytes(1000)
    for cut in (0, 1, 63, 64, 65, 999, 1000):
        first = digests.OpenDigest()
        first.update(data[:cut])
        then = digests.OpenDigest(first.state())
        then.update(data[cut:])
        assert then.hexdigest() == hashlib.sha256(data).hexdigest()
