"""Joins and filters that use a small side only after its size was checked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MAX_LITERAL_KEYS = 1_000
MAX_BROADCAST_ROWS = 500_000
#: Files of so many bytes hold few enough rows to send them to every task, even if they unpack to a hundred times that.
SMALL_BYTES = 1 << 20
SALTS = 64
#: Keys with more rows than ``HOT_ROWS`` are spread over ``SALTS`` tasks, the ``HOT_KEYS`` largest of them; another key
#: then holds at most one in ``HOT_KEYS`` of all rows.
HOT_ROWS = SALTS * 1_000
HOT_KEYS = 1_000


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a local relation, whose size the optimizer knows."""
    columns = [column.split()[0] for column in schema.split(", ")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=columns), schema)


def rows_within(df: DataFrame, bound: int) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``bound`` of them, else None."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def known_small(df: DataFrame) -> bool:
    """Whether the optimizer's own bound of the size, as from the sizes of files, is small. No job runs."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= SMALL_BYTES


def restrict_to_keys(
    tables: list[DataFrame],
    key: str,
    keys: DataFrame,
    exclude: bool = False,
    literal_bound: int = MAX_LITERAL_KEYS,
    broadcast_bound: int = MAX_BROADCAST_ROWS,
) -> list[DataFrame]:
    """The rows of each table whose ``key`` occurs (``exclude``: does not occur) in ``keys``.

    A few keys become an IN list, which Catalyst pushes through aggregates down to the scan
    (row groups are skipped when the table is sorted by the key). More keys are broadcast, so
    the tables stay in place. Only beyond that do both sides shuffle (``_spread_join``). The columns and
    their order stay at any size.
    """
    distinct = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    found = rows_within(distinct, literal_bound)
    if found is not None:
        listed = F.col(key).isin([row[0] for row in found])
        wanted = ~F.coalesce(listed, F.lit(False)) if exclude else listed
        return [df.filter(wanted) for df in tables]
    small = distinct.limit(broadcast_bound + 1).count() <= broadcast_bound
    how = "left_anti" if exclude else "left_semi"
    if small:
        return [df.join(F.broadcast(distinct), key, how).select(*df.columns) for df in tables]
    return [_spread_join(df, distinct, key, how).select(*df.columns) for df in tables]


def _salted(df: DataFrame, spread: Column) -> DataFrame:
    position = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS).cast("bigint"))
    return df.withColumn("_salt", F.when(spread, position).otherwise(F.lit(0).cast("bigint")))


def _spread_join(fact: DataFrame, dimension: DataFrame, on: str, how: str) -> DataFrame:
    """Both sides shuffle. One key may hold a large share of the fact table, so the rows of such keys are
    counted and salted by their position (stable for rows that come from a scan), and their dimension rows
    repeated once per salt; all other dimension rows go once. Null keys meet nothing and are salted as well.

    The hint keeps the join off the driver: the optimizer takes the repeated rows for as many as there were
    before, and would broadcast them.
    """
    per_key = fact.groupBy(on).agg(F.count(F.lit(1)).alias("_rows"))
    large = per_key.filter(F.col(on).isNotNull() & (F.col("_rows") > HOT_ROWS))
    hot = [row[0] for row in large.orderBy(F.desc("_rows")).limit(HOT_KEYS).collect()]
    is_hot = F.col(on).isin(hot)
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    salted = dimension.withColumn("_salt", F.explode(F.when(is_hot, salts).otherwise(F.array(F.lit(0).cast("bigint")))))
    rows = _salted(fact, F.col(on).isNull() | is_hot)
    return rows.join(salted.hint("merge"), [on, "_salt"], how).drop("_salt")


def join_dimension(
    fact: DataFrame,
    dimension: DataFrame,
    on: str,
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join a fact table to a narrow dimension (``how``: inner or left).

    Up to ``max_rows`` dimension rows are broadcast, so the fact rows stay where they are; they are
    counted unless the size of their files already tells. Beyond that both sides shuffle (``_spread_join``).
    """
    known = max_rows >= MAX_BROADCAST_ROWS and known_small(dimension)
    if known or dimension.limit(max_rows + 1).count() <= max_rows:
        return fact.join(F.broadcast(dimension), on, how)
    return _spread_join(fact, dimension, on, how)


def combine(left: DataFrame, right: DataFrame, right_key: str, bound: int) -> DataFrame:
    """Every row of ``left`` with every ``right_key``, without a cartesian product.

    The keys of a bounded right side travel as one literal array and are exploded in place.
    A larger right side is cut into fragments that are equi-joined, with the left rows spread
    over salts.
    """
    keys = rows_within(right.select(right_key), bound)
    if keys is not None:
        array = F.array([F.lit(row[0]) for row in keys]).cast("array<bigint>")
        return left.withColumn(right_key, F.explode(array))
    numbers = F.sequence(F.lit(0), F.lit(SALTS - 1))
    cells = left.withColumn(
        "_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    ).withColumn("_part", F.explode(numbers))
    parts = (
        right.select(right_key)
        .withColumn("_part", F.pmod(F.xxhash64(right_key), F.lit(SALTS)).cast("int"))
        .withColumn("_salt", F.explode(numbers))
    )
    return cells.join(parts, ["_salt", "_part"]).drop("_salt", "_part")

