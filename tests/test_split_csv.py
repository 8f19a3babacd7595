"""CSV records with line breaks, cut in byte ranges, against Spark's own one-task parser."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reviewlytics.sources import split_csv, tables
from reviewlytics.schema import raw_schema

SCHEMA = raw_schema("a", "b", "c")


def spark_rows(spark, path):
    reader = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("mode", "FAILFAST")
    reader = reader.option("columnPruning", False).option("quote", '"').option("escape", '"')
    return sorted((tuple(r) for r in reader.csv(path).collect()), key=str)


@pytest.fixture
def in_ranges(spark):
    """Reads in ranges of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def read(path, size):
        before = [spark.conf.get(n) for n in names]
        for name, value in zip(names, (str(size), "1")):
            spark.conf.set(name, value)
        try:  # The records are cut at once; reading them back needs no small ranges.
            return split_csv.read_split_csv(spark, path, SCHEMA)
        finally:
            for name, value in zip(names, before):
                spark.conf.set(name, value)

    return read


def field(rng):
    kind = rng.randrange(6)
    text = "".join(rng.choice('ab ,"\n\r') for _ in range(rng.randint(0, 12)))
    if kind == 0:
        return ""
    if kind == 1:
        return rng.choice(["plain", "é ü", '""', '"quoted"'])
    return '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize("seed", range(4))
def test_random_files(spark, in_ranges, tmp_path, seed):
    rng = random.Random(seed)
    ends = "\r\n" if seed == 3 else "\n"
    for k in range(3):
        records = ["a,b,c"] + [",".join(["x" if i == 0 else field(rng) for i in range(3)]) for _ in range(rng.randint(0, 60))]
        (tmp_path / f"f {k}%.csv").write_bytes((ends.join(records) + ends * rng.randint(0, 2)).encode())
    want = spark_rows(spark, str(tmp_path))
    for size in (97, 1 << 20):
        assert sorted((tuple(r) for r in in_ranges(str(tmp_path), size).collect()), key=str) == want


def test_quotes_at_the_borders_of_ranges(spark, in_ranges, tmp_path):
    text = 'a,b,c\n1,"x\n""\n",2\n3,"long\n' + "y\n" * 20 + '",4\n5,,6\n'
    (tmp_path / "f.csv").write_text(text)
    want = spark_rows(spark, str(tmp_path))
    assert len(want) == 3
    for size in (2, 3, 5, 7, 11, 16, 23, 30):
        assert sorted((tuple(r) for r in in_ranges(str(tmp_path), size).collect()), key=str) == want, size


def test_one_file_is_read_by_many_tasks(spark, in_ranges, tmp_path, monkeypatch):
    ranges, real = [], split_csv.range_states
    monkeypatch.setattr(split_csv, "range_states", lambda lines: ranges.append(lines.rdd.getNumPartitions()) or real(lines))
    (tmp_path / "f.csv").write_text("a,b,c\n" + "".join(f'{k},"x\n{k}",{"z" * 50}\n' for k in range(15_000)))
    rows = in_ranges(str(tmp_path), 100_000)
    assert ranges[0] >= 8
    assert rows.count() == 15_000 and rows.filter(F.col("b") == F.concat(F.lit("x\n"), "a")).count() == 15_000


@pytest.mark.parametrize("text", ['a,b,c\n1,"open,2\n', "a,b,c\n1,2\n", "a,b,c\n1,2,3,4\n"])
def test_malformed_records_stop_the_read(in_ranges, tmp_path, text):
    (tmp_path / "f.csv").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        in_ranges(str(tmp_path), 1 << 20).collect()


def test_empty_files(spark, in_ranges, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text('"a\nx",b,c')
    assert in_ranges(str(tmp_path), 4).collect() == []


def test_ranges_that_moved_are_told(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c\n1,2,3\n")
    lines = split_csv._lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="have changed"):
        lines.mapInArrow(split_csv._cut(spark.sparkContext.broadcast({})), split_csv._PIECES).collect()


def test_scratch_goes_after_the_load(spark, tmp_path, monkeypatch):
    from reviewlytics.operators import lineage

    folders = []
    real = lineage.Scratch.__init__
    monkeypatch.setattr(lineage.Scratch, "__init__", lambda self, s: real(self, s) or folders.append(self._folder))
    for name, text in {
        "hotels": "hotel_name,address,city,country,star_rating\nH,,R,,NA", "features": "feature_name,description,is_active\nF,,Y",
        "seeds": "feature_name,seed_phrase,weight\nF,x,1\nG,y,1", "reviews":
        'hotel_name,review_text,reviewer_name,review_date,overall_rating\nH,"a\nb",,,4\nNope,x,,,NA\nNope,z,,,NA',
    }.items():
        (tmp_path / "csv" / name).mkdir(parents=True)
        (tmp_path / "csv" / name / "f.csv").write_text(text)
    m = tables.load_tables(spark, str(tmp_path / "csv"), str(tmp_path / "t"), multi_line=True)
    assert [r.review_text for r in m.review.collect()] == ["a\nb"]
    rejected = {(r.table, tuple(r.key), r.reason, r.rows) for r in spark.read.parquet(str(tmp_path / "t" / "rejected")).collect()}
    assert rejected == {("seed", ("G", "y"), "unknown feature", 1), ("review", ("Nope",), "unknown hotel", 2)}
    from pathlib import Path

    assert folders and not any(Path(f.removeprefix("file://")).exists() for f in folders)
