"""Surrogate ids without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Three hexadecimal digits of a hash: at most 4096 groups, a fixed number.
_DIGITS = 3


def id_group(keys: list[str]) -> Column:
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.substring(F.md5(text.cast("binary")), 1, _DIGITS)


def assign_ids(df: DataFrame, id_column: str, keys: list[str], after: Column | int = 0):
    """Dense ids ``after + 1, after + 2, …`` in the order of (hash group of the keys, keys).

    ``keys`` must identify a row. Rows are numbered within 4096 hash groups in parallel; the
    only thing seen as a whole is the table of group sizes. The ids depend on the rows alone,
    so a recomputed task gives the same ones.
    """
    grouped = df.withColumn("_group", id_group(keys))
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    up_to_here = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_group", F.coalesce(F.sum("_rows").over(up_to_here), F.lit(0)).alias("_offset")
    )
    order = [F.col(k).asc_nulls_first() for k in keys]
    in_group = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    base = after if isinstance(after, Column) else F.lit(after)
    numbered = grouped.withColumn("_nth", in_group).join(F.broadcast(offsets), "_group")
    new_id = (base + F.col("_offset") + F.col("_nth")).cast("bigint")
    return numbered.select(new_id.alias(id_column), *df.columns)


def unique_ids(df: DataFrame, id_column: str, after: Column | int = 0) -> DataFrame:
    """Unique ids with gaps, for a fact table about to be written: no shuffle at all.

    The ids depend on the partitioning, so write the result before anything refers to them.
    """
    base = after if isinstance(after, Column) else F.lit(after)
    new_id = (base + 1 + F.monotonically_increasing_id()).cast("bigint")
    return df.select(new_id.alias(id_column), *df.columns)


def last_id(df: DataFrame, id_column: str) -> Column:
    """Highest id in use (0 for an empty table), as a scalar subquery."""
    return df.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("last")).scalar()
