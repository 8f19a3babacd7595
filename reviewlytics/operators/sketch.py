"""A Bloom filter as a column: thins rows before they are shuffled to a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
#: 2^26 bits are 8 MB, whatever the number of keys; beyond some five million keys more rows pass.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 26


def _places(key: Column, bits: int) -> list[Column]:
    """Four bits per key, from two hashes."""
    hashes = [F.xxhash64(key), F.xxhash64(key, F.lit(7))]
    return [
        F.shiftrightunsigned(h, by).bitwiseAND(F.lit(bits - 1).cast("bigint")) for h in hashes for by in (0, 32)
    ]


class BloomFilter:
    """Built from a column of keys by one aggregation; a key of the column always passes.

    The filter reaches the tasks as the value of a scalar subquery: it has a fixed size, and the keys
    themselves never leave the executors.
    """

    def __init__(self, keys: DataFrame, column: str):
        wanted = BITS_PER_KEY * keys.count()
        self.bits = min(max(LEAST_BITS, 1 << (wanted - 1).bit_length() if wanted else 0), MOST_BITS)
        place = F.explode(F.array(*_places(F.col(column), self.bits)))
        set_bits = keys.select(place.alias("place")).select(
            F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 AS int))").alias("value")
        )
        empty = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("value"))
        words = set_bits.unionByName(empty).groupBy("word").agg(F.bit_or("value").alias("value"))
        in_order = F.sort_array(F.collect_list(F.struct("word", "value")))
        self._words = words.agg(F.transform(in_order, lambda w: w["value"]).alias("words"))

    def may_contain(self, key: Column) -> Column:
        words = self._words.scalar()
        found = F.lit(True)
        for place in _places(key, self.bits):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            bit = F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
            found = found & (bit.bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return found
