"""Quoted files cut at any place give the records of the one-task reader."""

import csv
import random

import pytest

from cellwarden.sources import files
from cellwarden.sources.quoted import split_lines


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")

    yield cut
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def written(folder, rows, header=("id", "text", "note"), newline="\n"):
    with open(folder, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(header)
        w.writerows(rows)


def made(n, seed):
    rng = random.Random(seed)
    parts = ["plain", "a,b", 'say ""', '"', "\n", "\n\n", "é日本", ",", "", "long " * 60, '"\n"', "x\n,\n"]
    return [(i, "".join(rng.choices(parts, k=rng.randint(1, 6))) + "e", rng.choice(["", "n", "two\nlines"])) for i in range(n)]


@pytest.mark.parametrize("size, n", [(17, 8), (90, 30), (1000, 150), (1 << 20, 150)])
def test_cut_anywhere(spark, tmp_path, tiny_splits, size, n):
    rows = made(n, size)
    written(tmp_path / "a.csv", rows)
    tiny_splits(size)
    got = files.read_csv(spark, str(tmp_path / "a.csv"), splittable=True)
    one = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.schema == one.schema
    want = sorted((i, t, n or None) for i, t, n in rows)
    assert sorted(map(tuple, got.collect())) == want == sorted(map(tuple, one.collect()))
    if size == 1000:
        assert split_lines(spark, str(tmp_path / "a.csv")).select("start").distinct().count() > 10


def test_folder_headers_and_line_ends(spark, tmp_path, tiny_splits):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(2):
        written(folder / f"p{i}.csv", [(i * 10 + j, "a\nb" * j, "") for j in range(5)], ('i"d', "two\nlines", "note"), "\r\n")
    (folder / "empty.csv").write_text('"i""d","two\nlines",note\n')
    tiny_splits(20)
    got = files.read_csv(spark, str(folder), splittable=True)
    assert got.columns == ['i"d', "two\nlines", "note"]
    assert sorted((r[0], r[1]) for r in got.collect()) == [(i * 10 + j, "a\nb" * j or None) for i in range(2) for j in range(5)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(folder), encoding="latin-1", splittable=True)
