"""Small-side operators give the same rows whichever way their size makes them go."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reviewlytics.operators import bounded
from reviewlytics.operators.bounded import combine, join_dimension, restrict_to_keys, rows_within
from reviewlytics.operators.ids import assign_ids, last_id, unique_ids


@pytest.fixture(scope="module")
def fact(spark):
    """One key holds two thirds of the rows."""
    hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    return spark.range(300).select("id", hot.alias("k"), F.md5(F.col("id").cast("string")).alias("text"))


@pytest.fixture(scope="module")
def dimension(rows):
    return rows([("hot", 1), ("k0", 2), ("k1", 3), ("k1", 4)], "k string, d bigint")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_dimension(fact, dimension, how, plan_of):
    expected = sorted(fact.join(dimension, "k", how).select("id", "d").collect(), key=str)
    small = join_dimension(fact, dimension, "k", how)
    large = join_dimension(fact, dimension, "k", how, max_rows=2)
    assert "BroadcastHashJoin" in plan_of(small)
    assert "_salt" in plan_of(large)
    for joined in (small, large):
        assert sorted(joined.select("id", "d").collect(), key=str) == expected
    assert set(large.columns) == {"k", "id", "text", "d"}


@pytest.mark.parametrize("bound", [100, 2])
def test_combine(rows, bound, plan_of):
    left = rows([(i, f"n{i}") for i in range(20)], "a bigint, n string")
    right = rows([(10,), (11,), (12,)], "b bigint")
    both = combine(left, right, "b", bound)
    assert sorted((r.a, r.b) for r in both.collect()) == [(a, b) for a in range(20) for b in (10, 11, 12)]
    assert "Cartesian" not in plan_of(both) and "NestedLoop" not in plan_of(both)
    assert combine(left, right.filter("b > 99"), "b", bound).count() == 0


@pytest.mark.parametrize("bounds", [(1000, 1000), (1, 1000), (1, 1)])
@pytest.mark.parametrize("exclude", [False, True])
def test_restrict_to_keys(fact, rows, bounds, exclude):
    keys = rows([("hot",), ("hot",), ("k3",), (None,)], "k string")
    tables = restrict_to_keys([fact, fact.withColumn("k", F.lit(None).cast("string"))], "k", keys, exclude, *bounds)
    hit = fact.filter(F.col("k").isin("hot", "k3")).count()
    assert tables[0].count() == (300 - hit if exclude else hit)
    assert tables[1].count() == (300 if exclude else 0)
    assert all(t.columns == fact.columns for t in tables)
    [none] = restrict_to_keys([fact], "k", keys.filter("k = 'zzz'"), exclude, *bounds)
    assert none.count() == (300 if exclude else 0)


@pytest.mark.parametrize("hot_rows", [50, 1000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_large_sides_are_never_broadcast_and_only_hot_keys_repeated(monkeypatch, spark, fact, hot_rows, how, plan_of):
    monkeypatch.setattr(bounded, "HOT_ROWS", hot_rows)
    some = fact.withColumn("k", F.when(F.col("id") % 5 > 0, F.col("k")))
    keys = spark.range(200).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    if how in ("inner", "left"):
        joined = join_dimension(some, keys.withColumn("d", F.length("k")), "k", how, max_rows=2)
        expected = some.join(keys.withColumn("d", F.length("k")), "k", how)
    else:
        [joined] = restrict_to_keys([some], "k", keys, how == "left_anti", 1, 1)
        expected = some.join(keys, "k", how)
    assert "Broadcast" not in plan_of(joined)
    assert joined.select(*expected.columns).exceptAll(expected).isEmpty() and joined.count() == expected.count()
    sides, write = [], type(some).withColumn

    def seen(df, name, column):
        sides.append(write(df, name, column))
        return sides[-1]

    monkeypatch.setattr(type(some), "withColumn", seen)
    bounded._spread_join(some, keys, "k", "left_semi")
    # 200 keys of which one (none) is hot, not 64 times as many.
    assert sides[0].count() == (200 + 63 if hot_rows == 50 else 200)


def test_small_files_of_many_rows_are_counted(spark, tmp_path, plan_of):
    many = spark.range(600_000).select("id", F.lit(None).cast("string").alias("city"))
    many.coalesce(1).write.parquet(str(tmp_path / "dimension"))
    stored = spark.read.parquet(str(tmp_path / "dimension"))
    assert "Broadcast" not in plan_of(join_dimension(spark.range(10), stored, "id"))


def test_rows_within(spark):
    assert len(rows_within(spark.range(5), 5)) == 5
    assert rows_within(spark.range(6), 5) is None


def test_ids_are_dense_and_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.concat(F.lit("h"), F.col("id")).alias("name"), F.when(F.col("id") % 2 == 0, "c").alias("city"))
    one = {r.name: r.id for r in assign_ids(df.repartition(1), "id", ["name", "city"], 10).collect()}
    many = {r.name: r.id for r in assign_ids(df.repartition(9), "id", ["name", "city"], 10).collect()}
    assert one == many and sorted(one.values()) == list(range(11, 1011))


def test_ids_continue_after_the_last(spark):
    ids = spark.range(4).select(F.col("id").alias("i"))
    numbered = unique_ids(spark.range(50, numPartitions=5).select(F.col("id").alias("x")), "i", last_id(ids, "i"))
    got = [r.i for r in numbered.collect()]
    assert len(set(got)) == 50 and min(got) == 4
    assert spark.range(1).select(last_id(ids.filter("i > 9"), "i").alias("l")).first().l == 0
